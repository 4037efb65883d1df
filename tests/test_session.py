import pytest

from mergescope.session import shared_folder


class Unset:
    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_a_session_without_a_shared_folder_is_told_so(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Unset())
    assert shared_folder(spark)
