"""Secret scans in DataFrame expressions only.

Base kinds, leftmost and non-overlapping per kind: assign (a credential name, = or :,
a value of 8 characters or more), access (AKIA keys of 16 or more), hex (runs of 32 or
more).  The added kind, markov, scores every other run of TOKEN characters by two
first-order character Markov models, random strings against ordinary identifiers: it is
reported where the log-likelihood ratio reaches LEAST_TOTAL nats and LEAST_MEAN nats a
character, and only where it touches no base span.

The models are trained on labelled samples: values of base matches are the random
strings, the remaining runs of 6 or more characters are ordinary.  They come from at
most SAMPLE documents, taken in the order of a hash of the id; the scan covers every
whole text.  Positions are code points, ends exclusive.

Null and empty texts have no spans.  Rows repeat as in the input; other columns pass
through scan() untouched, except that names starting with _scan_ are reserved.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_of

# The kinds and their patterns, in order of precedence.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
KINDS = ("assign", "access", "hex", "markov")

SAMPLE = 3000
LEAST_TOTAL = 14.0
LEAST_MEAN = 0.7
#: Printable ASCII characters, the states of the chains.
STATES = 94
#: Characters of TOKEN, over which the random chain's prior spreads; prior counts of a row.
TOKEN_CHARS = 67
PRIOR = {"random": 8.0, "ordinary": 1.0}
#: No single transition weighs more, so that a few rare joints (camelCase, slashes) do
#: not make an identifier look random.
CLIP = 2.5
MASK = "[REDACTED]"
RUN = 128
_MATCHES = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; value
    is the group (or the whole match).  Positions are summed in runs of RUN matches, then
    over the runs, so that a text of many matches does not copy an ever longer array."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.filter(F.arrays_zip(F.transform(gaps, F.length).alias("gap"), hits.alias("hit"), values.alias("value")), lambda r: r["hit"].isNotNull())
    none = F.array().cast(_MATCHES)

    def place(acc, r):
        start = acc["pos"] + r["gap"]
        end = start + F.length(r["hit"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), r["value"].alias("value")))).alias("out"))

    def join(acc, run):
        moved = F.transform(run["out"], lambda m: F.struct((acc["pos"] + m["start"]).alias("start"), (acc["pos"] + m["end"]).alias("end"), m["value"].alias("value")))
        return F.struct((acc["pos"] + run["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def placed(all_rows):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_rows) - 1) / RUN).cast("int")), lambda i: F.aggregate(
            F.slice(all_rows, i * RUN + 1, RUN), F.struct(F.lit(0).alias("pos"), none.alias("out")), place))
        return F.aggregate(runs, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_MATCHES}>").alias("out")), join, lambda acc: F.flatten(acc["out"]))

    # the one-element array binds the rows, which are then computed once
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(rows), placed), F.lit(0))).otherwise(none)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with _scan_text, and _scan_base: array<struct<start, kind, end>> in order."""
    text = F.col("_scan_text")
    long = F.filter(matches(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= 8)
    return (docs.withColumn("_scan_text", text_of())
            .withColumn("_scan_base", F.array_sort(F.concat(
                _spans(long, 0), _spans(matches(text, ACCESS), 1), _spans(matches(text, HEX), 2)))))


def _runs(docs: DataFrame, random: bool) -> DataFrame:
    """One column, run: values of base matches, or runs in the text without them."""
    text = F.col("_scan_text")
    if random:
        values = F.concat(F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8),
                          F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    else:
        plain = reduce(lambda t, p: F.regexp_replace(t, p, " "), (ASSIGN, ACCESS, HEX), text)
        values = F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0))
    return docs.select(F.explode(values).alias("run"))


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of every transition, random over ordinary, row by row."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = docs.select("doc_id", text_of().alias("_scan_text")).join(F.broadcast(ids), "doc_id")
    pair = lambda i: F.struct(F.get("codes", i).alias("a"), F.get("codes", i + 1).alias("b"))
    counts = []
    for random in (True, False):
        runs = _runs(some, random).where(F.length("run") > 1).groupBy("run").count()
        coded = runs.select("count", _codes(F.col("run")).alias("codes"))
        pairs = coded.select("count", F.explode(F.transform(F.sequence(F.lit(0), F.size("codes") - 2), pair)).alias("p"))
        counts.append(pairs.groupBy("p.a", "p.b").agg(F.sum("count").alias("random" if random else "ordinary")))
    grid = docs.sparkSession.range(STATES * STATES).select((F.col("id") / STATES).cast("int").alias("a"), (F.col("id") % STATES).cast("int").alias("b"))
    both = grid.join(F.broadcast(counts[0]), ["a", "b"], "left").join(F.broadcast(counts[1]), ["a", "b"], "left").fillna(0)
    total = both.groupBy("a").agg(F.sum("random").alias("nr"), F.sum("ordinary").alias("no"))
    token = F.chr(F.col("b") + 33).rlike("[A-Za-z0-9+/_=-]").cast("double")
    uniform = {"random": token / TOKEN_CHARS, "ordinary": F.lit(1 / STATES)}
    prob = lambda n, all_: (F.col(n) + PRIOR[n] * uniform[n] + 1e-6) / (F.col(all_) + PRIOR[n] + 1e-6 * STATES)
    rows = (both.join(F.broadcast(total), "a").orderBy("a", "b")
            .select(F.round(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.log(prob("random", "nr") / prob("ordinary", "no")))), 6).alias("r")).collect())
    return [r.r for r in rows]


def _codes(s: Column) -> Column:
    """The states of a string's characters, in time linear in its length."""
    return F.transform(F.split(s, ""), lambda c: F.ascii(c) - 33)


def _below(ascending: Column, x: Column, also_equal: bool) -> Column:
    """How many values of the array are less than x (or equal), by bisection."""
    def step(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        v = F.get(ascending, mid)
        up = v <= x if also_equal else v < x
        return F.when(acc["lo"] >= acc["hi"], acc).when(up, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ascending) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(ascending).alias("hi")), step, lambda acc: acc["lo"])


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs with base (spans of the base kinds) and spans (all), both
    array<struct<start, kind, end>> in order of start and kind."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    # the one-element array binds the codes, which are then computed once
    llr = lambda s: F.get(F.transform(F.array(_codes(s)), lambda c: F.aggregate(
        F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0),
        lambda acc, i: acc + F.get(table, F.get(c, i) * STATES + F.get(c, i + 1)))), F.lit(0))
    d = base_spans(docs).withColumn("_scan_runs", matches(F.col("_scan_text"), TOKEN))
    d = d.withColumn("_scan_starts", F.transform("_scan_base", lambda s: s["start"])).withColumn("_scan_ends", F.array_sort(F.transform("_scan_base", lambda s: s["end"])))
    # base spans that begin before a run's end, less those that end before it begins
    touched = lambda r: _below(F.col("_scan_starts"), r["end"], False) > _below(F.col("_scan_ends"), r["start"], True)
    d = d.withColumn("_scan_runs", F.when(F.size("_scan_base") == 0, F.col("_scan_runs")).otherwise(F.filter("_scan_runs", lambda r: ~touched(r))))
    d = d.withColumn("_scan_runs", F.transform("_scan_runs", lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), llr(r["value"]).alias("llr"))))
    odd = F.filter("_scan_runs", lambda r: (r["llr"] >= LEAST_TOTAL) & (r["llr"] >= LEAST_MEAN * (r["end"] - r["start"])))
    d = d.withColumn("_scan_all", F.array_sort(F.concat("_scan_base", _spans(odd, 3))))
    return d.select(*docs.columns, F.col("_scan_base").alias("base"), F.col("_scan_all").alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per document."""
    found = scan(docs.select("doc_id", "text"), ratios)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def masked(text: Column, spans: Column) -> Column:
    """text with MASK for each span (overlapping spans count as one, adjacent ones do
    not).  Pieces are cut in runs of RUN from a part of the text, so that a long text of
    many spans is not read from its beginning for each."""
    ordered = F.struct(text.alias("t"), F.array_sort(F.transform(spans, lambda s: s["start"])).alias("s"), F.array_sort(F.transform(spans, lambda s: s["end"])).alias("e"))

    def cover(v):
        # where nothing is open: as many spans have begun before as have ended
        begin = F.array_distinct(F.filter(v["s"], lambda x: _below(v["s"], x, False) == _below(v["e"], x, True)))
        end = F.array_distinct(F.filter(v["e"], lambda x: _below(v["e"], x, True) == _below(v["s"], x, False)))
        return F.struct(v["t"].alias("t"), F.length(v["t"]).alias("n"), begin.alias("s"), end.alias("e"))

    def joined(v):
        last = F.size(v["s"])
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get(v["e"], i - 1))
        end = lambda i: F.when(i == last, v["n"]).otherwise(F.get(v["s"], i))

        def run(c):
            low, high = c * RUN, F.least(last, c * RUN + RUN - 1)
            return _bound(v["t"].substr(begin(low) + 1, end(high) - begin(low)), lambda part: F.transform(
                F.sequence(low, high), lambda i: part.substr(begin(i) - begin(low) + 1, end(i) - begin(i))))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.floor(last / RUN).cast("int")), run)), MASK)

    return _bound(_bound(ordered, cover), joined)


def redact(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs with every span replaced by MASK (overlapping spans by one); n_chars, where
    present, follows the text.  Rows and other columns stay as they are."""
    clean = (scan(docs.withColumnsRenamed({"base": "_scan_b", "spans": "_scan_s"}), ratios).withColumnRenamed("spans", "_spans")
             .withColumn("text", F.when(F.size("_spans") > 0, masked(text_of(), F.col("_spans"))).otherwise(F.col("text")))
             .withColumnsRenamed({"base": "_scan_drop"}).withColumnsRenamed({"_scan_b": "base", "_scan_s": "spans"}))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)
