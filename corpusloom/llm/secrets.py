"""Secret scans with DataFrame functions only: pattern spans and entropy spans.

Patterns give the base spans. Besides, each long candidate string is scanned by a sliding
window: the Shannon entropy of its characters is kept by incremental counts, as moving the
window changes the count of the character that leaves and of the one that enters. The
threshold depends on the candidate's character class. A candidate that the allow list
matches as a whole, or inside a base span, is suppressed; a placeholder within a candidate
suppresses the windows that overlap it.

A match's place is the sum of the lengths of what split() leaves before it and of the
matches before it. Everything is one projection: no shuffle and no Python.

Defined results: a null or empty text has no spans. Each row stands alone, so repeated
rows are repeated. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import running

#: The base kinds in their order, with their patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: Strings that look random but are no secrets: UUIDs, dates with times,
#: words joined by one kind of mark, paths of words, and placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9A-Za-z+-]+$",
    r"^[A-Za-z]+([_/-][A-Za-z]+)+([_/-]?[0-9]{1,4})?$",
    r"(?i)(example|placeholder|changeme|xxxx|0000|1234567)",
)
#: The words of the last pattern, which stand anywhere in a candidate.
PLACEHOLDERS = ("example", "placeholder", "changeme", "xxxx", "0000", "1234567")
#: Each character of a placeholder, also where placeholders overlap.
_IN_PLACEHOLDER = "(?i)" + "|".join(f"(?<={w[:k]}){w[k]}(?={w[k + 1 :]})" for w in PLACEHOLDERS for k in range(len(w)))


@dataclass(frozen=True)
class SecretParams:
    window: int = 20
    #: Least bits per character in some window, by class: hex digits, letters, letters and digits, base64.
    #: Words without a mark between them hold no digit, so letters alone need more.
    hex_bits: float = 3.0
    letter_bits: float = 3.9
    alnum_bits: float = 3.6
    base64_bits: float = 3.8


def _placed(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """Array of (start, end, g) for each match; g is the length of the last of `groups`."""
    kind = "array<struct<start:int,end:int,g:int>>"
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), *(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), F.length).alias(f"m{g}") for g in groups))
    # The last gap has no match.
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["m0"]).alias("end"), x[f"m{groups[-1]}"].alias("g"))
    placed = running(F.filter(parts, lambda x: x["m0"].isNotNull()), F.lit(0), lambda at, x: at + x["gap"] + x["m0"], span, kind[6:-1])
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(kind))


def _spans(found: Column, order: int, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _hot(candidate: Column, params: SecretParams) -> Column:
    """(first, last): start of the first and end of the last window at the threshold; null if none."""
    wide = params.window
    bits = F.when(candidate.rlike("^[0-9a-fA-F]+$"), params.hex_bits).when(candidate.rlike("^[A-Za-z]+$"), params.letter_bits).when(candidate.rlike("^[0-9A-Za-z]+$"), params.alnum_bits).otherwise(params.base64_bits)
    masked = F.when(candidate.rlike(ALLOWED[-1]), F.regexp_replace(candidate, _IN_PLACEHOLDER, " ")).otherwise(candidate)
    logs = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(wide + 1)))
    n_log_n = lambda n: F.get(logs, n)

    def scan(x: Column) -> Column:
        # Each character is a number in the candidate's alphabet; counts holds one count a number.
        codes = x["codes"]

        def step(acc: Column, i: Column) -> Column:
            here, gone = F.get(codes, i - 1), F.when(i > wide, F.get(codes, i - wide - 1)).otherwise(-1)
            out, held = F.get(acc["counts"], gone), F.get(acc["counts"], here)
            held = F.when(here == gone, held - 1).otherwise(held)
            less = F.when(gone >= 0, n_log_n(out) - n_log_n(out - 1)).otherwise(0.0)
            total = acc["s"] - less + n_log_n(held + 1) - n_log_n(held)
            counts = F.transform(acc["counts"], lambda n, k: n + F.when(k == here, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0))
            # Characters since the last placeholder; a window that overlaps one does not count.
            clear = F.when(here == x["blank"], 0).otherwise(acc["clear"] + 1)
            high = (clear >= wide) & (F.lit(math.log2(wide)) - total / wide >= x["bits"] - 1e-9)
            return F.struct(total.alias("s"), counts.alias("counts"), clear.alias("clear"), F.when(high, F.coalesce(acc["first"], i - wide)).otherwise(acc["first"]).alias("first"), F.when(high, i).otherwise(acc["last"]).alias("last"))

        start = F.struct(F.lit(0.0).alias("s"), x["none"].alias("counts"), F.lit(0).alias("clear"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    bind = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    coded = lambda x: F.struct(
        F.transform(x["chars"], lambda c: (F.array_position(x["letters"], c) - 1).cast("int")).alias("codes"),
        (F.array_position(x["letters"], " ") - 1).cast("int").alias("blank"),
        F.transform(x["letters"], lambda c: F.lit(0)).alias("none"),
        bits.alias("bits"),
    )
    return bind(bind(bind(F.split(masked, ""), lambda c: F.struct(c.alias("chars"), F.array_distinct(c).alias("letters"))), coded), scan)


def _outside(found: Column, base: Column) -> Column:
    """The candidates that no base span holds whole: one pass over both, in the order of their starts."""
    kind = "struct<start:int,order:int,end:int,s:string>"
    empty = F.lit(None).cast("string")
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("order"), b["end"].alias("end"), empty.alias("s")))
    asked = F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("order"), (c["start"] + F.length(c["s"])).alias("end"), c["s"].alias("s")))
    free = running(F.array_sort(F.concat(spans, asked)), F.lit(0), lambda most, x: F.when(x["order"] == 0, F.greatest(most, x["end"])).otherwise(most), lambda most, x: F.when((x["order"] == 1) & (x["end"] > most), x), kind)
    return F.filter(free, lambda x: x.isNotNull())


def scan(docs: DataFrame, params: SecretParams = SecretParams(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` with n_assign, n_access, n_hex, base_sha256, n_entropy and spans."""
    text = F.coalesce("text", F.lit(""))
    kept = docs.select(*carry, F.struct(text.alias("text")).alias("__t"))
    text = F.col("__t.text")
    # Lengths under the minimum are dropped after matching: the match was still used up.
    placed = kept.select(
        *carry,
        "__t",
        F.filter(_placed(text, ASSIGN, (0, 2)), lambda x: x["g"] >= 12).alias("__assign"),
        F.filter(_placed(text, ACCESS, (0,)), lambda x: x["end"] - x["start"] >= 18).alias("__access"),
        _placed(text, HEX, (0,)).alias("__hex"),
        F.when(text.rlike(CANDIDATE), F.transform(F.arrays_zip(_placed(text, CANDIDATE, (0,)).alias("at"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("s")), lambda x: F.struct(x["at"]["start"].alias("start"), x["s"].alias("s")))).alias("__long"),
    )
    base = F.array_sort(F.concat(_spans(F.col("__assign"), 0, "assign"), _spans(F.col("__access"), 1, "access"), _spans(F.col("__hex"), 2, "hex")))
    with_base = placed.withColumn("__base", base).drop("__t")

    allowed = lambda s: F.greatest(*(s.rlike(p) for p in ALLOWED[:-1]))
    asked = F.when(F.size("__long") > 0, _outside(F.filter("__long", lambda c: ~allowed(c["s"])), F.col("__base")))
    hot = F.transform(asked, lambda c: F.struct(c["start"].alias("start"), _hot(c["s"], params).alias("h")))
    extra = F.transform(F.filter(hot, lambda c: c["h"]["first"].isNotNull()), lambda c: F.struct((c["start"] + c["h"]["first"]).alias("start"), F.lit(3).alias("order"), (c["start"] + c["h"]["last"]).alias("end"), F.lit("entropy").alias("kind")))
    extra = F.coalesce(extra, F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>"))
    done = with_base.withColumn("__extra", extra)
    return done.select(
        *carry,
        F.size("__assign").cast("long").alias("n_assign"),
        F.size("__access").cast("long").alias("n_access"),
        F.size("__hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        F.size("__extra").cast("long").alias("n_entropy"),
        _joined(F.array_sort(F.concat("__base", "__extra"))).alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL for the query with the default parameters."""
    p = SecretParams()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("candidate", CANDIDATE, 0))
    found = " union all ".join(
        f"select doc_id, {k} as k, '{kind}' as kind, regexp_extract_all(text, {quote(pattern)}) as m, regexp_extract_all(text, {quote(pattern)}, {group}) as g, string_split_regex(text, {quote(pattern)}) as gaps from t where regexp_matches(text, {quote(pattern)})"
        for k, (kind, pattern, group) in enumerate(kinds)
    )
    allowed = " or ".join(f"regexp_matches(s, {quote(a)})" for a in ALLOWED[:-1])
    bits = f"case when regexp_matches(s, '^[0-9a-fA-F]+$') then {p.hex_bits} when regexp_matches(s, '^[A-Za-z]+$') then {p.letter_bits} when regexp_matches(s, '^[0-9A-Za-z]+$') then {p.alnum_bits} else {p.base64_bits} end"
    # A placeholder overlaps a window if the window, longer by all but one of its characters on both sides, holds it.
    near = " or ".join(f"contains(lower(substr(s, greatest(1, i - {len(w) - 1}), least(i - 1, {len(w) - 1}) + {p.window + len(w) - 1})), '{w}')" for w in PLACEHOLDERS)
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
f as ({found}),
x as (select doc_id, k, kind, m, g, gaps, unnest(range(1, len(m) + 1)) as i from f),
y as (select doc_id, k, kind, m[i] as s, length(g[i]) as gl, (list_sum(list_transform(gaps[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0))::BIGINT as a from x),
b as (select doc_id, k, kind, a, a + length(s) as z from y where k = 0 and gl >= 12 or k = 1 and length(s) >= 18 or k = 2),
c as (select doc_id, s, a, {bits} as bits from y where k = 3 and not ({allowed})),
o as (select c.* from c where not exists (select 1 from b where b.doc_id = c.doc_id and b.a <= c.a and b.z >= c.a + length(c.s))),
w as (select doc_id, s, a, bits, unnest(range(1, length(s) - {p.window} + 2)) as i from o),
h as (select doc_id, a, bits, i, unnest(string_split(substr(s, i, {p.window}), '')) as ch from w where not ({near})),
n as (select doc_id, a, bits, i, ch, count(*)::DOUBLE as n from h group by all),
e as (select doc_id, a, bits, i from n group by doc_id, a, bits, i having -sum(n / {p.window} * log2(n / {p.window})) >= bits - 1e-9),
q as (select doc_id, 3 as k, 'entropy' as kind, a + min(i) - 1 as p, a + max(i) - 1 + {p.window} as z from e group by doc_id, a),
j as (select doc_id, k, kind, a, z from b union all select doc_id, k, kind, p, z from q),
g as (select doc_id, count(case when k = 0 then 1 end) as n_assign, count(case when k = 1 then 1 end) as n_access, count(case when k = 2 then 1 end) as n_hex, count(case when k = 3 then 1 end) as n_entropy,
  string_agg(case when k < 3 then kind || ':' || a::VARCHAR || ':' || z::VARCHAR end, ',' order by a, k) as base, string_agg(kind || ':' || a::VARCHAR || ':' || z::VARCHAR, ',' order by a, k) as spans from j group by doc_id)
select t.doc_id, coalesce(n_assign, 0)::BIGINT as n_assign, coalesce(n_access, 0)::BIGINT as n_access, coalesce(n_hex, 0)::BIGINT as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(n_entropy, 0)::BIGINT as n_entropy, coalesce(spans, '') as spans
from t left join g on g.doc_id = t.doc_id"""
