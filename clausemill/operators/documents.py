"""Documents to paragraphs to chunks, and the report of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.functions.numeric import half_even
from clausemill.operators.relational import running_sum
from clausemill.session import written

TokenCount = Callable[[Column], Column]


def word_tokens(c: Column) -> Column:
    """The default token count: words and single punctuation marks. A subword vocabulary counts differently."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = r"\n\n", least: int = 15) -> DataFrame:
    """(doc_id, paragraph_id, text, skipped): non-empty parts in order; short ones stay, marked skipped."""
    parts = F.filter(F.transform(F.split(T.line_ends(F.col(text)), separator), T.strip), lambda p: p != "")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("paragraph_id", "text"))
    return rows.withColumn("skipped", F.length("text") < least)


def sentences(c: Column) -> Column:
    """Sentences by rule: a run ends behind . ! or ? and closing marks, where a blank follows."""
    return F.array_remove(F.transform(F.split(c, r"(?<=[.!?][\"')\]]?)(?<=\S)\s+"), T.strip), "")


def packed(parts: Column, count: TokenCount, limit: int) -> Column:
    """Greedy packing: parts joined by a space while their counts fit the limit; a larger part stands alone."""
    start = F.struct(F.expr("array()").cast("array<int>").alias("cuts"), F.lit(0).alias("n"), F.lit(1).alias("i"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["n"] + n > limit) | (acc["i"] == 1)
        return F.struct(F.when(full, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"]).alias("cuts"), F.when(full, n).otherwise(acc["n"] + n).alias("n"), (acc["i"] + 1).alias("i"))

    def joined(p: Column) -> Column:  # only the places of cuts are gathered, not the texts
        cuts = F.aggregate(F.transform(p, lambda x: count(x).cast("int")), start, step, lambda acc: acc["cuts"])
        one = lambda c: F.transform(c, lambda at, i: F.array_join(F.slice(p, at, F.coalesce(F.get(c, i + 1), F.size(p) + 1) - at), " "))
        return F.transform(F.array(cuts), one).getItem(0)

    return F.transform(F.array(parts), joined).getItem(0)


def _cut(text: Column, count: TokenCount, limit: int, split: Callable[[Column], Column]) -> Column:
    """A paragraph in chunks: whole if it fits, else its sentences packed."""
    return F.when(count(text) <= limit, F.array(text)).otherwise(packed(split(text), count, limit))


def chunks(paras: DataFrame, count: TokenCount = word_tokens, limit: int = 256, split: Callable[[Column], Column] = sentences) -> DataFrame:
    """(doc_id, chunk_id, paragraph_id, text, estimated_tokens, is_subchunk) of the paragraphs that are not skipped."""
    rows = paras.where("NOT skipped").select("doc_id", "paragraph_id", _cut(F.col("text"), count, limit, split).alias("parts"))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_id", "parts"))).alias("ps"))
    return _numbered(lists, count)


def _numbered(lists: DataFrame, count: TokenCount) -> DataFrame:
    flat = F.flatten(F.transform("ps", lambda p: F.transform(p["parts"], lambda t: F.struct(p["paragraph_id"].alias("paragraph_id"), t.alias("text"), (F.size(p["parts"]) > 1).alias("is_subchunk")))))
    told = lists.select("doc_id", F.posexplode(flat).alias("chunk_id", "c"))
    return told.select("doc_id", "chunk_id", "c.paragraph_id", "c.text", count(F.col("c.text")).alias("estimated_tokens"), "c.is_subchunk")


def document_chunks(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    separator: str = r"\n\n",
    least: int = 15,
    count: TokenCount = word_tokens,
    limit: int = 256,
    split: Callable[[Column], Column] = sentences,
) -> DataFrame:
    """``chunks`` of ``paragraphs``, numbered inside each document's row: nothing is shuffled, and rows that share an id stay apart.

    ``split`` cuts a paragraph into sentences: the rule, or a fitted ``SentenceModel.sentences``; ``count`` counts
    tokens by a column expression. ``subword_chunks`` counts by a vocabulary.
    """
    parts = F.filter(F.transform(F.split(T.line_ends(F.col(text)), separator), T.strip), lambda p: p != "")
    placed = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("paragraph_id"), p.alias("text"))), lambda p: F.length(p["text"]) >= least)
    ps = F.transform(placed, lambda p: F.struct(p["paragraph_id"].alias("paragraph_id"), _cut(p["text"], count, limit, split).alias("parts")))
    return _numbered(docs.select(F.col(doc_id).alias("doc_id"), ps.alias("ps")), count)


def subword_chunks(docs: DataFrame, count: TokenCount, doc_id: str = "doc_id", text: str = "text", separator: str = r"\n\n", least: int = 15, limit: int = 256, split: Callable[[Column], Column] = sentences) -> DataFrame:
    """``document_chunks`` with the counts of ``functions.subword.counter``, which sees a document's paragraphs and sentences once.

    A count of sentences joined by a blank is the sum of theirs, as no piece holds a blank.
    """
    parts = F.filter(F.transform(F.split(T.line_ends(F.col(text)), separator), T.strip), lambda p: p != "")
    placed = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("paragraph_id"), p.alias("text"))), lambda p: F.length(p["text"]) >= least)
    rows = docs.select(F.col(doc_id).alias("doc_id"), placed.alias("ps"))
    rows = rows.withColumn("ps", F.transform("ps", lambda p: F.struct(p["paragraph_id"].alias("paragraph_id"), F.concat(F.array(p["text"]), split(p["text"])).alias("texts"))))
    rows = rows.withColumn("counts", count(F.transform("ps", lambda p: p["texts"])))
    start = F.struct(F.expr("array()").cast("array<int>").alias("cuts"), F.lit(0).alias("n"), F.lit(1).alias("i"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["n"] + n > limit) | (acc["i"] == 1)
        return F.struct(F.when(full, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"]).alias("cuts"), F.when(full, n).otherwise(acc["n"] + n).alias("n"), (acc["i"] + 1).alias("i"))

    def chunks_of(p: Column, counts: Column) -> Column:
        whole = F.array(F.struct(p["texts"][0].alias("text"), counts[0].alias("n"), F.lit(False).alias("sub")))
        texts, sizes = F.slice(p["texts"], 2, F.size(p["texts"])), F.slice(counts, 2, F.size(counts))

        def joined(cuts: Column) -> Column:
            def one(at: Column, i: Column) -> Column:
                n = F.coalesce(F.get(cuts, i + 1), F.size(texts) + 1) - at
                total = F.aggregate(F.slice(sizes, at, n), F.lit(0), lambda a, x: a + x)
                return F.struct(F.array_join(F.slice(texts, at, n), " ").alias("text"), total.alias("n"), (F.size(cuts) > 1).alias("sub"))

            return F.transform(cuts, one)

        several = F.transform(F.array(F.aggregate(sizes, start, step, lambda acc: acc["cuts"])), joined)[0]
        return F.transform(F.when(counts[0] <= limit, whole).otherwise(several), lambda c: F.struct(p["paragraph_id"].alias("paragraph_id"), c["text"].alias("text"), c["n"].alias("n"), c["sub"].alias("sub")))

    flat = F.flatten(F.transform("ps", lambda p, i: chunks_of(p, F.get("counts", i))))
    return rows.select("doc_id", F.posexplode(flat).alias("chunk_id", "c")).select("doc_id", "chunk_id", "c.paragraph_id", "c.text", F.col("c.n").alias("estimated_tokens"), F.col("c.sub").alias("is_subchunk"))


def overlapping_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of about ``size`` characters that overlap; a paragraph end, else a sentence end, in the second half ends a chunk."""
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be below half of the size")

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for key, value in zip(pdf["doc_id"], pdf["text"], strict=True):
                value, start, number = value or "", 0, 0
                while start < len(value):
                    end = min(start + size, len(value))
                    if end < len(value):
                        middle = start + size // 2
                        stop = value.rfind("\n\n", middle + 1, end)
                        if stop < 0 and (stop := value.rfind(". ", middle + 1, end)) >= 0:
                            stop += 1
                        end = stop if stop >= 0 else end
                    if piece := value[start:end].strip():
                        out.append((key, number, piece))
                        number += 1
                    if end == len(value):
                        break
                    start = end - overlap
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "text"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, chunk_index long, text string")


def length_profile(df: DataFrame, value: Column, limit: float, *keys: str) -> DataFrame:
    """Exact percentiles 50, 90, 95 and 99 (interpolated), least, largest, and the share above a limit.

    See ``percentiles``: no task holds all values, nor all distinct ones.
    """
    own = df.select(*keys, value.alias("__v"))
    grouped = own.groupBy(*keys) if keys else own
    told = grouped.agg(F.count("__v").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), F.avg((F.col("__v") > limit).cast("double")).alias("share_over"))
    shares = percentiles(own, "__v", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, *keys)
    order = [*keys, "n", "p50", "p90", "p95", "p99", "least", "most", "share_over"]
    if not keys:
        return told.crossJoin(F.broadcast(shares)).select(order)  # one row each
    same = None
    for k in keys:  # a null key is a key
        one = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = one if same is None else same & one
    return told.alias("a").join(shares.alias("b"), same, "left").select(*[F.col(f"a.{k}") for k in keys], *order[len(keys) :])


#: Parts that one round of ``percentiles`` cuts an open range into.
BINS = 256


def percentiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """(keys, a column a share): the interpolated percentiles of non-null values, exactly.

    Each wanted rank lies in a range of values, at first from the least to the largest. A round counts, for every open
    range, the values in each of ``BINS`` equal parts of it, and keeps the part with the rank, from its least to its
    largest value; a range is closed when its values are equal. The state of a task and what is shuffled are counts of
    parts, whatever the number of values. Values are finite; each round leaves less of a range, and a few are enough
    where values do not differ by many powers of ``BINS``.
    """
    own = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    names = list(shares)
    spans = (own.groupBy(*keys) if keys else own).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    # both neighbours of a rank are sought: it is interpolated between them
    position = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(i).alias("side"), (F.floor(position(s)) if i == 0 else F.ceil(position(s))).cast("long").alias("rank")) for name, s in shares.items() for i in (0, 1)]
    open_ = spans.where("n > 0").select(*keys, F.explode(F.array(*wanted)).alias("w"), "low", "high", F.lit(0).cast("long").alias("below"), "n").select(*keys, "w.*", "low", "high", "below", "n")
    open_ = written(open_, "ranks")
    while not open_.where("low < high").isEmpty():
        # distinct ranges: several ranks may lie in one
        ranges = open_.where("low < high").select(*keys, "low", "high").distinct()
        joined = _same(own, ranges, keys).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        width = (F.col("high") / BINS) - (F.col("low") / BINS)
        place = F.floor(F.try_divide(F.col("v") - F.col("low"), width)).cast("double")
        part = F.when(width > 0, F.least(F.lit(BINS - 1.0), place)).otherwise((F.col("v") > F.col("low")).cast("double")).cast("int")
        counts = joined.groupBy(*keys, "low", "high", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        lists = counts.groupBy(*keys, "low", "high").agg(F.array_sort(F.collect_list(F.struct("part", "c", "least", "most"))).alias("parts"))
        told = _same(open_.where("low < high"), lists, keys, "low", "high")

        def seek(parts, rest):
            start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("struct<below:bigint,c:bigint,least:double,most:double>").alias("found"))

            def step(acc, p):
                here = acc["found"].isNull() & (rest < acc["before"] + p["c"])
                hit = F.struct(acc["before"].alias("below"), p["c"].alias("c"), p["least"].alias("least"), p["most"].alias("most"))
                return F.struct((acc["before"] + p["c"]).alias("before"), F.when(here, hit).otherwise(acc["found"]).alias("found"))

            return F.aggregate(parts, start, step, lambda acc: acc["found"])

        found = told.withColumn("f", seek(F.col("parts"), F.col("rank") - F.col("below")))
        found = found.select(*keys, "name", "side", "rank", F.col("f.least").alias("low"), F.col("f.most").alias("high"), (F.col("below") + F.col("f.below")).alias("below"), F.col("f.c").alias("n"))
        open_ = written(open_.where("low >= high").unionByName(found), "ranks")
    sizes = spans.where("n > 0").select(*keys, F.col("n").alias("of"))
    closed = _same(open_, sizes, keys) if keys else open_.crossJoin(F.broadcast(sizes))
    side = lambda name, i: F.max(F.when((F.col("name") == name) & (F.col("side") == i), F.col("low")))

    def between(name: str):
        place = F.lit(float(shares[name])) * (F.max("of") - 1)
        return (side(name, 0) + (side(name, 1) - side(name, 0)) * (place - F.floor(place))).alias(name)

    return (closed.groupBy(*keys) if keys else closed).agg(*[between(name) for name in names])


def _same(a: DataFrame, b: DataFrame, keys, *more: str) -> DataFrame:
    """Inner join on keys, where a null key is a key, and on further columns; without keys b is a few ranges, sent to all."""
    on = None
    for k in [*keys, *more]:
        one = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = one if on is None else on & one
    b = b if keys else F.broadcast(b)
    joined = a.alias("a").join(b.alias("b"), on) if on is not None else a.alias("a").crossJoin(b.alias("b"))
    return joined.select(*[F.col(f"a.{c}") for c in a.columns], *[F.col(f"b.{c}") for c in b.columns if c not in keys and c not in more])




def upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Least, upper middle and largest value: element n div 2 of the sorted list, not interpolated.

    It is found in running sums of the counts of distinct values, so no list of all values is gathered.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    through = running_sum(sizes, F.col("__n"), "__through", [value], list(keys))
    own = sizes.groupBy(*keys) if keys else sizes
    totals = own.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.sum("__n").alias("__total"))
    told = through.join(totals, list(keys)) if keys else through.crossJoin(F.broadcast(totals))
    told = told.where(F.col("__through") > F.floor(F.col("__total") / 2))
    out = told.groupBy(*keys, "least", "most") if keys else told.groupBy("least", "most")
    return out.agg(F.min(value).alias("upper_median")).select(*keys, "least", "upper_median", "most")


def document_report(paras: DataFrame, pieces: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Per document: paragraphs, skipped ones, chunks, sub-chunked paragraphs, tokens and the share of harmful chunks."""
    p = paras.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.count_if("skipped").alias("n_skipped"))
    c = pieces.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"),
        F.countDistinct(F.when(F.col("is_subchunk"), F.col("paragraph_id"))).alias("n_subchunked"),
        F.sum("estimated_tokens").alias("n_tokens"),
    )
    out = p.join(c, "doc_id", "left").na.fill(0, ["n_chunks", "n_subchunked", "n_tokens"])
    if predictions is not None:
        h = predictions.groupBy("doc_id").agg(F.avg((F.col("harm_class") == 0).cast("double")).alias("harmful_share"))
        out = out.join(h, "doc_id", "left")
    return out


def restored(paras: DataFrame, predictions: DataFrame) -> DataFrame:
    """All paragraphs in document order, those that were skipped without predictions, first within their paragraph."""
    told = paras.select("doc_id", "paragraph_id", "skipped").join(predictions, ["doc_id", "paragraph_id"], "left")
    return told.orderBy("doc_id", "paragraph_id", F.col("chunk_id").asc_nulls_first())


def clause_list(predictions: DataFrame, harm: list[str] | None = None) -> DataFrame:
    """The flat clause list of an answer: text, primary topic, harm class, confidence; filtered by harm before any costly step."""
    names = harm_filter(harm)
    rows = predictions.where(F.col("predicted_harm_class").isin(names))
    return rows.select("chunk_id", "text", F.coalesce(F.get("predicted_topics", F.lit(0)), F.lit("unclassified")).alias("primary_topic"), "predicted_harm_class", half_even(F.col("harm_confidence")).alias("harm_confidence"))


#: Names of the harm classes by which a caller may ask for them.
HARM_ALIASES = {"harmful": "Harmful", "bad": "Harmful", "-1": "Harmful", "neutral": "Neutral", "0": "Neutral", "fair": "Fair", "good": "Fair", "1": "Fair"}


def harm_filter(names: list[str] | None) -> list[str]:
    """Class names from a caller's list: blank ones are ignored, none means harmful only, unknown ones raise."""
    asked = [n.strip().lower() for n in names or [] if n and n.strip()]
    if unknown := [n for n in asked if n not in HARM_ALIASES]:
        raise ValueError(f"unknown harm classes: {unknown}")
    return sorted({HARM_ALIASES[n] for n in asked}) or ["Harmful"]
