"""Study parameters shared by the operators and the named queries."""

# Author-group labels as they occur in the pull-request data.
AGENTS = ("Copilot", "Cursor", "Claude_Code", "Devin")
EXCLUDED_AGENT = "OpenAI_Codex"
HUMAN = "human"
HUMAN_GROUP = "Human"

SEED = 42
MIN_GROUP_SIZE = 5
SHA_BATCH_SIZE = 500
MAX_PATCH_BYTES = 1_000_000
PREVIEW_ROWS = 20
HISTOGRAM_BINS = 20

REPO_API_PREFIX = "https://api.github.com/repos/"
