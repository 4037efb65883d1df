"""SQL fragments shared by the statements."""

AGENTS = ("Copilot", "Cursor", "Claude_Code", "Devin")
GROUPS = (*AGENTS, "Human")


def erfc(x: str) -> str:
    """Complementary error function from its Taylor series; exact zero beyond four, where rounding hides it."""
    return (
        f"(CASE WHEN ({x}) > 4 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), "
        f"lambda k: pow(-1, k) * pow({x}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) END)"
    )


def chi_p(chi2: str) -> str:
    return erfc(f"sqrt({chi2} / 2)")


def z_p(z: str) -> str:
    return f"least({erfc(f'{z} / sqrt(2)')}, 1.0)"


def stars(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"


def rnd(x: str, digits: int) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(round_even(({x})::DOUBLE * {scale}, 0)::DOUBLE / {scale})"


def yates(a: str, na: str, b: str, nb: str) -> str:
    """Corrected chi-square of hits a of na against b of nb, written over the four cells."""
    terms = []
    for observed, row, column in (
        (a, na, f"({a} + {b})"), (f"({na} - {a})", na, f"({na} + {nb} - {a} - {b})"),
        (b, nb, f"({a} + {b})"), (f"({nb} - {b})", nb, f"({na} + {nb} - {a} - {b})"),
    ):
        e = f"({row}::DOUBLE * {column} / ({na} + {nb}))"
        d = f"abs({observed}::DOUBLE - {e})"
        terms.append(f"pow({d} - least(0.5, {d}), 2) / nullif({e}, 0)")
    return "(" + " + ".join(terms) + ")"


def u_test(rows: str, key: str) -> str:
    """U, z and p per key from (key, is_first, x) rows, through ranks with ties averaged."""
    by = f"PARTITION BY {key}" if key else ""
    head = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    group_x = f"GROUP BY {key}, x" if key else "GROUP BY x"
    ranked = f"""SELECT *, rank() OVER ({by} ORDER BY x) + (count(*) OVER (PARTITION BY {head} x) - 1) / 2.0 AS mid FROM ({rows}) WHERE x IS NOT NULL"""
    sums = f"""SELECT {head} count(*) FILTER (is_first) AS n1, count(*) FILTER (NOT is_first) AS n2,
        sum(mid) FILTER (is_first) AS r1 FROM ({ranked}) {group}"""
    ties = f"""SELECT {head} sum(t * t * t - t) AS ties FROM (SELECT {head} count(*)::DOUBLE AS t FROM ({rows}) WHERE x IS NOT NULL {group_x}) {group}"""
    join = f"JOIN ({ties}) USING ({key})" if key else f"CROSS JOIN ({ties})"
    base = f"""SELECT *, r1 - n1::DOUBLE * (n1 + 1) / 2 AS u, n1::DOUBLE * n2 AS nn, (n1 + n2)::DOUBLE AS n FROM ({sums}) {join} WHERE n1 > 0 AND n2 > 0"""
    scored = f"""SELECT *, (greatest(u, nn - u) - nn / 2 - 0.5) / sqrt(nn / 12 * (n + 1 - coalesce(ties / nullif(n * (n - 1), 0), 0))) AS z FROM ({base})"""
    ruled = f"SELECT *, least(n1, n2) <= 8 AND ties = 0 AS tiny, CAST(floor(nn - greatest(u, nn - u)) AS BIGINT) AS last FROM ({scored})"
    return f"SELECT *, CASE WHEN tiny THEN {exact_p()} ELSE {z_p('z')} END AS p, CASE WHEN tiny THEN 'exact' ELSE 'normal' END AS method FROM ({ruled})"


def exact_p() -> str:
    """Two-sided permutation p from n1, n2 and last, the largest U of the lower tail.

    Ways to choose ranks, coefficient by coefficient: one more member of the smaller sample takes away what lies a whole
    larger sample further on and adds up every i-th coefficient before.
    """
    m, n = "least(n1, n2)", "greatest(n1, n2)"
    i = "e[1]::BIGINT"
    less = f"(w[j - t * {i} + 1] - CASE WHEN j - t * {i} >= {n} + {i} THEN w[j - t * {i} - {n} - {i} + 1] ELSE 0 END)"
    step = f"list_transform(range(0, last + 1), lambda j: list_sum(list_transform(range(0, j // {i} + 1), lambda t: {less})))"
    start = "list_transform(range(0, last + 1), lambda j: CASE WHEN j = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END)"
    ways = f"list_reduce(list_transform(range(1, {m} + 1), lambda i: [i::DOUBLE]), lambda w, e: {step}, {start})"
    choices = f"list_reduce(list_transform(range(1, {m} + 1), lambda i: i::DOUBLE), lambda c, i: c * ({n} + i) / i, 1.0::DOUBLE)"
    return f"least(1.0, 2 * list_sum({ways})::DOUBLE / {choices})"


def wide(values: tuple[str, ...], key: str, measure: str) -> str:
    return ", ".join(f"max({measure}) FILTER ({key} = '{v}') AS \"{v}\"" for v in values)
