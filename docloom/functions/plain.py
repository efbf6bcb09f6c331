"""SQL pieces for the independent equivalents that a plain SQL engine runs; written apart from the columns they check."""

from __future__ import annotations

from docloom.functions import texts


def listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


def canonical(x: str) -> str:
    bare = f"regexp_replace(trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')"
    s = fold(bare)
    kept = f"list_filter(string_split({s}, ' '), lambda w: w <> '' AND w NOT IN {listed(texts.LEGAL)})"
    return f"""CASE WHEN len(string_split({bare}, ' ')) <= 5 AND length({s}) >= 3 AND length(regexp_replace({s}, '[^\\p{{L}}]', '', 'g')) >= 2
        AND length(regexp_replace({s}, '[^\\p{{N}}]', '', 'g')) <= 0.30 * length({s}) AND len({kept}) > 0
        AND len(list_filter({kept}, lambda w: w NOT IN {listed(texts.STRUCTURE)})) > 0 THEN array_to_string({kept}, ' ') END"""


def valid_argument(x: str) -> str:
    return f"length(trim({x})) >= 3 AND len({words(f'trim({x})')}) <= 6 AND NOT regexp_matches(trim({x}), '^[0-9 .,;:%$€£¥+–—/()-]*$') AND length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) >= 2"


def grounded(text: str, value: str) -> str:
    telling = f"list_filter(regexp_split_to_array(trim({value}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND w NOT IN {listed(texts.PREDICATE_STOP)})"
    return f"(contains({text}, trim({value})) OR (len({telling}) > 0 AND len(list_filter({telling}, lambda w: contains({text}, w))) / len({telling}) >= 0.6))"


def predicate(x: str) -> str:
    p = f"regexp_replace({fold(f'trim({x})')}, '[^a-z0-9 ]', ' ', 'g')"
    kept = f"list_filter(string_split({p}, ' '), lambda w: w <> '' AND w NOT IN {listed(texts.PREDICATE_STOP)})"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE trim({p}) END"


def tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({fold(x)}, '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN {listed(texts.UNTELLING)})))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def values(rows, columns: str) -> str:
    """Rows of Python as a table: columns are written 'name type, ...'."""
    names, kinds = zip(*(c.strip().split(" ", 1) for c in columns.split(",")))
    kinds = [{"string": "varchar", "long": "bigint"}.get(k, k.replace("array<string>", "varchar[]").replace("array<double>", "double[]").replace("array<int>", "int[]")) for k in kinds]

    def lit(v, k):
        if v is None:
            return f"cast(NULL AS {k})"
        if isinstance(v, (list, tuple)):
            return f"cast([{', '.join(lit(x, k[:-2]) for x in v)}] AS {k})"
        if isinstance(v, bool):
            return str(v).lower()
        return "cast('" + str(v).replace("'", "''") + f"' AS {k})"

    body = ", ".join("(" + ", ".join(lit(v, k) for v, k in zip(r, kinds)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(names)}))"
