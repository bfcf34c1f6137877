"""SQL fragments shared by the checking statements."""

from __future__ import annotations

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(x: str) -> str:
    return f"(case when regexp_matches({x}, '{NUMBER}') then try_cast(trim({x}) as double) end)"


def date(x: str) -> str:
    formats = "['%Y-%m-%d', '%d-%m-%Y', '%d/%m/%Y', '%Y/%m/%d', '%d.%m.%Y', '%Y.%m.%d']"
    return f"cast(try_strptime(trim({x}), {formats}) as date)"


def share(x: str) -> str:
    left, right = number(f"split_part({x}, '/', 1)"), number(f"split_part({x}, '/', 2)")
    percent = number(f"trim(replace({x}, '%', ''))")
    return (
        f"coalesce(case when contains({x}, '/') then case when len(string_split({x}, '/')) = 2 "
        f"then {left} / nullif({right}, 0) end when contains({x}, '%') then {percent} / 100.0 "
        f"else {number(x)} end, 0)"
    )


def rounded(x: str, digits: int) -> str:
    scale = f"cast({10 ** digits} as double)"
    return f"(sign({x}) * floor(abs({x}) * {scale} + cast(0.5 as double)) / {scale})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def mask_name(x: str) -> str:
    mask = (
        "case when length(w) <= 2 then left(w, 1) || '*' "
        "else left(w, 1) || repeat('*', length(w) - 2) || right(w, 1) end"
    )
    return (
        f"case when length({x}) >= 2 then array_to_string(list_transform({words(x)}, lambda w: {mask}), ' ') "
        f"else '****' end"
    )


def text_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def text_map(pairs: dict[str, str]) -> str:
    return f"map({text_list(list(pairs))}, {text_list(list(pairs.values()))})"


def rows(names: list[str], values: list[tuple]) -> str:
    """A constant table."""
    cell = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in values)
    return f"(values {body}) t({', '.join(names)})"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, one row of the table per character of ``a``."""
    match = f"list_transform(string_split({a}, ''), lambda c: list_transform(string_split({b}, ''), lambda d: cast(c = d as int)))"
    step = (
        "list_transform(range(1, len(m) + 1), lambda j: "
        "greatest(p[j], case when m[j] = 1 then coalesce(p[j - 1], 0) + 1 else 0 end))"
    )
    best = f"list_transform(range(1, len(m) + 1), lambda k: list_max(({step})[1:k]))"
    start = f"list_transform(string_split({b}, ''), lambda d: 0)"
    return f"list_max(list_reduce({match}, lambda p, m: {best}, {start}))"


def ratio(a: str, b: str) -> str:
    return f"(200.0 * {lcs(a, b)} / (length({a}) + length({b})))"
