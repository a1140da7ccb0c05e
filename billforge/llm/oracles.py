"""SQL of the corpus operators that SQL can say, built step by step where a step repeats."""

from __future__ import annotations

from itertools import permutations


def crc32_sql(digits: str) -> str:
    """Unsigned crc32 of an ASCII string expression, four bits at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table.append(c)
    half = f"xor(%s >> 4, list_extract(CAST({table} AS UBIGINT[]), CAST(%s & 15 AS INTEGER) + 1))"
    first = half.replace("%s", "xor(a, b)")
    steps = f"list_transform(string_split({digits}, ''), lambda c: CAST(ascii(c) AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {steps}), lambda a, b: {half.replace('%s', first)}), 4294967295::UBIGINT)"


def _tree(name: str, levels: int) -> str:
    """Levels of 16-ary trees over ``{name}0`` (tree, i, n, h): ``{name}N``, what stands beside each node in ``{name}rN``, the tops in ``{name}top``."""
    over = "OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN {})"
    out = []
    for k in range(1, levels + 1):
        beside = (f"coalesce(string_agg(h, '') {over.format(x)}, '')" for x in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        out.append(f"{name}r{k} AS (SELECT *, {next(beside)} AS bef, {next(beside)} AS aft FROM {name}{k - 1} WHERE n > 1)")
        out.append(f"{name}{k} AS (SELECT tree, i // 16 AS i, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k - 1} WHERE n > 1 GROUP BY ALL)")
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ",\n ".join([*out, f"{name}top AS ({tops})"])


def _fold(of: str, name: str, start: str, levels: int, tree: str, place: str) -> str:
    """Tables ``{of}fN``: the rows of ``{of}`` with ``h`` folded up the tree ``name`` from the expression ``start``, and ``proof`` longer by each level."""
    out, at = [f"{of}f0 AS (SELECT *, {start} AS fold FROM {of})"], f"{of}f0"
    for k in range(1, levels + 1):
        out.append(f"""{of}f{k} AS (SELECT d.* REPLACE (CASE WHEN r.h IS NULL THEN d.fold ELSE sha256(r.bef || d.fold || r.aft) END AS fold, d.proof || coalesce(r.bef || r.aft, '') AS proof)
  FROM {at} AS d LEFT JOIN {name}r{k} AS r ON r.tree = d.{tree} AND r.i = d.{place} // {16 ** (k - 1)})""")
        at = f"{of}f{k}"
    return ",\n ".join(out)


def merkle_sql(levels: int = 6, upper: int = 4) -> str:
    def told(c: str) -> str:
        v = f"CAST({c} AS VARCHAR)"
        return f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')"

    ids = " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars"))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = f"translate(text, '{letters}', '{letters.lower()}')"
    return f"""WITH x AS (SELECT doc_id, source, sha256({ids} || {told('text')}) AS leaf, sha256({ids} || {told(lower)}) AS altered,
  {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 AS tampered FROM documents),
 d AS (SELECT *, '' AS proof, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY source) AS size FROM x),
 s0 AS (SELECT tree, place AS i, size AS n, leaf AS h FROM d),
 {_tree('s', levels)},
 u0 AS (SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, h FROM stop),
 {_tree('u', upper)},
 {_fold('d', 's', 'CASE WHEN tampered THEN altered ELSE leaf END', levels, 'tree', 'place')},
 t AS (SELECT d.*, stop.h AS subroot, 0 AS top FROM df{levels} AS d JOIN stop ON stop.tree = d.tree),
 {_fold('t', 'u', 'fold', upper, 'top', 'tree').replace('SELECT *, fold AS fold', 'SELECT *', 1)}
 SELECT doc_id, leaf, subroot, utop.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = utop.h AS verified FROM tf{upper}, utop"""


def filter_audit_sql() -> str:
    words = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, part, t, {words} AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
 f AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM w),
 l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
 m AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
  count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
 o AS (SELECT o AS filter_order, step, o[step] AS letter, o[1:step - 1] AS before FROM (VALUES {orders}) AS v(o), range(1, 6) AS r(step)),
 g AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS failing, regexp_matches(fails, '[' || before || '_]') AS earlier, fails = letter AS alone FROM m, o),
 r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN failing OR earlier THEN 0 ELSE n END) AS kept, sum(CASE WHEN failing AND NOT earlier THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN failing AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN failing AND NOT earlier THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN failing AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost FROM g GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""
