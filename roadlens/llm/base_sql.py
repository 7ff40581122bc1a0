"""SQL of the base spans of personal data and secrets, as their contracts tell them."""

from __future__ import annotations

#: kind -> (expression, condition on the match ``s``). Fixed values, as the contracts give them.
PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 or try_cast(ltrim(x, '0') as int) > 255)) = 0"),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        "length(digits) between 13 and 19 and list_sum(list_transform(range(1, cast(least(length(digits), 20) as bigint) + 1), "
        "lambda i: case when i % 2 = 1 then cast('0' || substr(digits, length(digits) + 1 - i, 1) as int) "
        "else (2 * cast('0' || substr(digits, length(digits) + 1 - i, 1) as int)) // 10 + (2 * cast('0' || substr(digits, length(digits) + 1 - i, 1) as int)) % 10 end)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) between 9 and 15"),
}
_CUE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
SECRETS = {
    "assign": (rf"""({_CUE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""length(regexp_extract(s, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""),
    "access": (r"AKIA[A-Z0-9]+", "length(s) >= 20"),
    # A run of 24 hex digits or more is a whole match of the expression for one or more.
    "hex": (r"[0-9a-f]{24,}", "true"),
}


def base_sql(kinds: dict[str, tuple[str, str]], order: str) -> str:
    """doc_id, n_kind of each kind, base_sha256 over documents. Places come from what stands between the matches."""
    parts, held = [], []
    for i, (kind, (expression, condition)) in enumerate(kinds.items()):
        pattern = expression.replace("'", "''")
        parts.append(
            f"u{i} as (select rid, unnest(regexp_extract_all(t, '{pattern}')) as s, unnest(regexp_split_to_array(t, '{pattern}')) as gap, unnest(range(1, len(regexp_split_to_array(t, '{pattern}')) + 1)) as i from d), "
            f"s{i} as (select rid, s, regexp_replace(s, '[^0-9]', '', 'g') as digits, cast(sum(length(gap)) over w + coalesce(sum(length(s)) over w, 0) - length(s) as bigint) as a from u{i} window w as (partition by rid order by i))"
        )
        held.append(f"select rid, {i} as k, '{kind}' as kind, a, a + length(s) as e from s{i} where s is not null and {condition}")
    counts = ", ".join(f"cast(count(*) filter (kind = '{kind}') as bigint) as n_{kind}" for kind in kinds)
    names = ", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind in kinds)
    return (
        f"with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), {', '.join(parts)}, h as ({' union all '.join(held)}), "
        f"g as (select rid, {counts}, string_agg(kind || ':' || a || ':' || e, ',' order by {order}) as listed from h group by rid) "
        f"select doc_id, {names}, sha256(coalesce(listed, '')) as base_sha256 from d left join g on d.rid = g.rid"
    )


PERSONAL_DATA_BASE = base_sql(PERSONAL, "k, a")
SECRETS_BASE = base_sql(SECRETS, "a, k")
