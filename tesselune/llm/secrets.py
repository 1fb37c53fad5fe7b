"""Secrets in texts, by DataFrame functions alone: fixed patterns, and spans of high entropy.

Candidates for entropy are long runs of key characters with digits and letters in them. A window slides over
a candidate while one fold keeps the count of each character of its class (hex digits, or all key characters)
and the sum of count * log2(count), both changed only by the character that enters and the one that leaves.
Windows at or above the class's threshold merge to spans; candidates on the allow-list are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in the order in which ties of start are listed.
BASE = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",  # AKIA[A-Z0-9]+ of 18 or more
    "hex": r"[0-9a-f]{16,}",  # [0-9a-f]+ of 16 or more
}
#: The alphabets whose characters are counted, and the least entropy in bits of a window of 20.
ALPHABETS = {"hex": "0123456789abcdefABCDEF", "key": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"}
BITS = {"hex": 3.0, "key": 3.6}
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: What marks a candidate as no secret: placeholders, counted-up runs, UUIDs.
ALLOWED = (
    "(?i)example",
    "(?i)x{6,}",
    "0123456789",
    "(?i)abcdefghij",
    "(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$",
)


_SPANS = "array<struct<start:bigint,end:bigint,hit:string>>"


#: Matches that one fold appends, so that a text of many costs no more a match than one of few.
RUN = 256


def _places(kind: str) -> Column:
    """array<struct<start, end, hit>> from the columns of a kind's matches and of the gaps around them.

    The gaps come from a split by the same pattern, so places, in code points, are running sums of lengths:
    within runs of ``RUN`` matches, and over the runs.
    """
    # what a lambda reads many times is bound to a variable first: a column may be computed anew at each reading
    fold = f"""aggregate(slice(found, CAST(r * {RUN} + 1 AS int), {RUN}),
          named_struct('at', 0L, 'out', CAST(array() AS {_SPANS})),
          (a, x) -> named_struct('at', a.at + x.gap + x.len, 'out', concat(a.out, array(named_struct(
            'start', a.at + x.gap, 'end', a.at + x.gap + x.len, 'hit', x.hit)))))"""
    found = f"""transform(filter(arrays_zip({kind}_gap, {kind}_hit), x -> x.{kind}_hit IS NOT NULL), x -> named_struct(
          'gap', CAST(char_length(x.{kind}_gap) AS bigint), 'len', CAST(char_length(x.{kind}_hit) AS bigint), 'hit', x.{kind}_hit))"""
    return F.expr(f"""
        IF(size({kind}_hit) = 0, CAST(array() AS {_SPANS}), element_at(transform(
          transform(array({found}), found -> transform(sequence(0, (size(found) - 1) div {RUN}), r -> {fold})),
          runs -> flatten(zip_with(
            runs,
            aggregate(runs, named_struct('at', 0L, 'out', CAST(array() AS array<bigint>)), (a, r) -> named_struct('at', a.at + r.at, 'out', concat(a.out, array(a.at))), a -> a.out),
            (r, earlier) -> transform(r.out, m -> named_struct('start', m.start + earlier, 'end', m.end + earlier, 'hit', m.hit))))), 1))""")


def _sql_list(values: list) -> str:
    return "array(" + ", ".join(map(str, values)) + ")"


def _hot(kind: str, window: int, bits: float) -> str:
    """Merged windows of high entropy over the candidate c, as array<struct<start, end>> within it."""
    alphabet = ALPHABETS[kind]
    table = _sql_list([f"{n * math.log2(n) if n else 0.0!r}D" for n in range(window + 1)])
    return f"""
      aggregate(
        element_at(transform(array(transform(regexp_extract_all(c.hit, '.', 0), x -> locate(x, '{alphabet}'))), places ->
          transform(places, (p, k) -> named_struct('i', k + 1, 'new', p, 'old', IF(k >= {window}, get(places, k - {window}), 0)))), 1),
        named_struct('counts', array_repeat(0, {len(alphabet)}), 'sum', 0.0D, 'out', CAST(array() AS array<struct<start:int,end:int>>)),
        (b, x) -> element_at(transform(array(b), a -> element_at(transform(array(
            named_struct('counts', IF(x.old > 0, transform(a.counts, (n, k) -> n - IF(k = x.old - 1, 1, 0)), a.counts),
                         'sum', a.sum + IF(x.old > 0, element_at({table}, a.counts[greatest(x.old, 1) - 1]) - element_at({table}, a.counts[greatest(x.old, 1) - 1] + 1), 0.0D),
                         'out', a.out)),
          m -> element_at(transform(array(
            named_struct('counts', transform(m.counts, (n, k) -> n + IF(k = x.new - 1, 1, 0)),
                         'sum', m.sum + element_at({table}, m.counts[x.new - 1] + 2) - element_at({table}, m.counts[x.new - 1] + 1),
                         'out', m.out)),
          w -> named_struct('counts', w.counts, 'sum', w.sum, 'out',
            CASE WHEN x.i < {window} OR round({math.log2(window)!r}D - w.sum / {window}, 9) < {bits}D THEN w.out
                 WHEN size(w.out) > 0 AND element_at(w.out, -1).end >= x.i - {window}
                   THEN concat(slice(w.out, 1, size(w.out) - 1), array(named_struct('start', element_at(w.out, -1).start, 'end', x.i)))
                 ELSE concat(w.out, array(named_struct('start', x.i - {window}, 'end', x.i))) END)), 1)), 1)), 1),
        b -> b.out)"""


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each input row.

    Matches are leftmost and non-overlapping for each kind; an assignment's value must have 12 characters.
    A span reads kind:start:end in code points, end exclusive, for the whole match; spans are sorted by start,
    then kind (assign, access, hex, entropy), and joined by commas. A null text is an empty one and has none.
    Repeated rows are scanned each on their own; an empty table gives no rows; other columns are ignored.
    """
    value = BASE["assign"].replace("\\", "\\\\").replace("'", "\\'")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    patterns = BASE | {"candidates": CANDIDATE}
    found = texts.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_hit") for k, p in patterns.items()])
    found = found.select("*", *[F.when(F.size(f"{k}_hit") > 0, F.split("text", p, -1)).alias(f"{k}_gap") for k, p in patterns.items()])
    found = found.select("doc_id", *[_places(k).alias(k) for k in patterns])
    found = found.withColumn("assign", F.expr(f"filter(assign, m -> char_length(regexp_extract(m.hit, '{value}', 2)) >= 12)"))
    quoted = [a.replace("\\", "\\\\").replace("'", "\\'") for a in allowed]
    listed = " AND ".join(f"NOT c.hit RLIKE '{a}'" for a in quoted) or "true"
    found = found.withColumn("candidates", F.expr(f"filter(candidates, c -> c.hit RLIKE '[0-9]' AND c.hit RLIKE '[A-Za-z]' AND {listed})"))
    hot = F.expr(f"""flatten(transform(candidates, c -> transform(
        CASE WHEN c.hit RLIKE '^[0-9a-fA-F]+$' THEN {_hot("hex", WINDOW, BITS["hex"])} ELSE {_hot("key", WINDOW, BITS["key"])} END,
        s -> named_struct('start', c.start + s.start, 'end', c.start + s.end, 'hit', ''))))""")
    found = found.withColumn("entropy", hot)
    joined = "array_join(transform(array_sort(concat({})), s -> concat_ws(':', element_at(array('assign', 'access', 'hex', 'entropy'), s.rank), s.start, s.end)), ',')"
    part = "transform({}, m -> named_struct('start', m.start, 'rank', {}, 'end', m.end))"
    parts = [part.format(k, n) for n, k in enumerate(["assign", "access", "hex", "entropy"], 1)]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(joined.format(", ".join(parts[:3]))), 256).alias("base_sha256"),
        F.expr(joined.format(", ".join(parts))).alias("spans"),
    )
