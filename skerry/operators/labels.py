"""Gold labels by matching values, leakage screens, and near duplicates by their words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.facts import value_formats
from skerry.functions.text import ngrams, overlap_tokens, share_of, tokens
from skerry.operators import setjoin
from skerry.runtime import small, staged

#: Characters that formatted values are made of, in runs.
NUMBER_RUN = "[0-9.,-]{3,}"
LONGEST = 30  # characters of the longest format


def number_parts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(ticker, year, chunk_id, variant)``: the ``wanted(ticker, variant)`` that each chunk's text contains.

    A variant is made of digits, commas, points and minus signs only, so a text contains it just if
    one of its runs of these does. So containment becomes an equality with the parts of the runs,
    and no pair of a fact and a chunk is ever looked at in vain.
    """
    year = F.left("report_date", F.lit(4)).try_cast("int")
    runs = chunks.filter("ticker IS NOT NULL AND text IS NOT NULL").select("ticker", year.alias("year"), "chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBER_RUN), F.lit(0)))).alias("run")).distinct()
    n = F.length("run")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.transform(F.sequence(F.lit(3), F.least(n - i + 1, F.lit(LONGEST))), lambda k: F.substring(F.col("run"), i, k))))
    parts = F.filter(parts, lambda p: p.rlike("^-?[0-9].*[0-9]$"))
    by_run = runs.select("ticker", "run").distinct().select("ticker", "run", F.explode(F.array_distinct(parts)).alias("variant"))
    hit = by_run.join(wanted.select("ticker", "variant").distinct(), ["ticker", "variant"])
    return runs.join(hit, ["ticker", "run"]).select("ticker", "year", "chunk_id", "variant").distinct()


def value_matches(facts: DataFrame, chunks: DataFrame, years: int = 2, most: int | None = None) -> DataFrame:
    """``(fact_id, chunk_id)``: chunks of the fact's ticker, from a filing of its fiscal year or up to ``years`` later, whose text contains a format of its value.

    ``facts(fact_id, ticker, fiscal_year, value)``. With ``most``, only facts with 1 to ``most``
    chunks come out: how many a variant has in a year is counted first, so that a variant found
    everywhere never meets its chunks.
    """
    v = facts.select("fact_id", "ticker", "fiscal_year", F.explode(value_formats("value")).alias("variant")).filter("fiscal_year IS NOT NULL")
    found = number_parts(chunks, v)
    v = v.withColumn("year", F.explode(F.sequence(F.col("fiscal_year"), F.col("fiscal_year") + years)))
    if most is None:
        return v.join(found, ["ticker", "variant", "year"]).select("fact_id", "chunk_id").distinct()
    counts = found.groupBy("ticker", "variant", "year").agg(F.count("*").alias("n"))
    fit = v.join(counts, ["ticker", "variant", "year"]).groupBy("fact_id").agg(F.max("n").alias("n")).filter(F.col("n") <= most).select("fact_id")
    m = v.join(fit, "fact_id", "left_semi").join(found, ["ticker", "variant", "year"]).select("fact_id", "chunk_id").distinct()
    few = m.groupBy("fact_id").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("fact_id")
    return m.join(few, "fact_id", "left_semi")


def idf(corpus: DataFrame) -> DataFrame:
    """``(term, df, idf)`` of ``corpus(id, text)``: ``ln(N / (1 + df))``, which isn't positive for a term of nearly every document."""
    n = corpus.count()
    terms = corpus.select(F.explode(F.array_distinct(tokens("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.round(F.ln(F.lit(float(n)) / (1 + F.col("df"))), 9))


def _token_pairs(pairs: DataFrame) -> DataFrame:
    """``(pid, q, g)``: the content words of question and gold text, in order; a missing gold text has none."""
    return pairs.select("pid", tokens("question").alias("q"), F.coalesce(tokens("gold_text"), F.array().cast("array<string>")).alias("g"))


def _overlap(p: DataFrame, weights: DataFrame) -> DataFrame:
    each = p.select("pid", "g", F.explode(F.array_distinct("q")).alias("term"))
    each = each.select("pid", "term", F.array_contains("g", F.col("term")).alias("shared")).join(weights.select("term", "idf"), "term", "left")
    w = F.coalesce("idf", F.lit(0.0))
    s = each.groupBy("pid").agg(F.sum(w).alias("all"), F.sum(F.when(F.col("shared"), w).otherwise(0.0)).alias("got"))
    return p.select("pid").join(s, "pid", "left").select("pid", F.round(F.coalesce(share_of(F.col("got"), F.col("all")), F.lit(0.0)), 6).alias("overlap"))


def idf_overlap(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """``(pid, overlap)`` of ``pairs(pid, question, gold_text)``: the share of the question's idf that words of the gold text hold; 0 if it has none."""
    return _overlap(staged(_token_pairs(pairs)), weights)


def screened(pairs: DataFrame, weights: DataFrame, n: int = 4, most: float = 0.725) -> DataFrame:
    """``(pid, overlap, reason)``: why a question gives its passage away, the first that holds; null if it doesn't.

    ``too short`` under four content words; a shared run of ``n`` content words; an idf overlap above
    ``most``. Words are taken from the texts once.
    """
    t = staged(_token_pairs(pairs))
    p = t.select("pid", F.size("q").alias("k"), F.arrays_overlap(ngrams("q", n), ngrams("g", n)).alias("copied")).join(_overlap(t, weights), "pid")
    reason = F.when(F.col("k") < 4, F.lit("too short")).when(F.coalesce("copied", F.lit(False)), F.lit(f"shared {n}-gram")).when(F.col("overlap") > most, F.format_string("idf overlap %.2f", "overlap"))
    return p.select("pid", "overlap", reason.alias("reason"))


def rejections(screened: DataFrame) -> DataFrame:
    """``(reason, n)`` by the first word of the reason."""
    return screened.filter("reason IS NOT NULL").groupBy(F.split("reason", " ")[0].alias("reason")).agg(F.count("*").alias("n"))


def lexical_overlap(pairs: DataFrame) -> DataFrame:
    """``(qid, overlap)`` of ``pairs(qid, question, gold_text)``, one row a gold text: the share of the question's words that any of its gold texts has."""
    each = pairs.select("qid", "question", F.coalesce("gold_text", F.lit("")).alias("t"))
    hit = each.select("qid", overlap_tokens("question").alias("q"), F.explode(F.array_intersect(overlap_tokens("question"), overlap_tokens("t"))).alias("w")).select("qid", "w").distinct().groupBy("qid").agg(F.count("*").alias("hit"))
    size = each.select("qid", F.size(overlap_tokens("question")).alias("size")).distinct()
    return size.join(hit, "qid", "left").select("qid", F.round(share_of(F.coalesce("hit", F.lit(0)).cast("double"), F.col("size")), 6).alias("overlap"))


def _sets(records: DataFrame) -> DataFrame:
    """``(group, id, set, key)``: the sorted distinct words, and a digest that only equal sets share. The set of a null text is null."""
    r = records.select("id", "group", F.array_sort(F.array_distinct(tokens("text"))).alias("set"))
    # Words hold no space. A key that can't be null needs no filter, for which the words would be taken twice.
    return r.select("group", "id", "set", F.coalesce(F.unhex(F.sha2(F.array_join("set", " "), 256)), F.lit(b"")).alias("key"))


def similar_sets(records: DataFrame, least: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """``(group, a, b, similarity)``, ``a < b``, and ``(group, id, cls)``: which classes of records of one group are similar, exactly, and the class of every record.

    ``records(id, group, text)``. Records of a group with the same set of words are one class, named by its
    least id; two records are similar if they are of one class or of two classes linked. A link means a
    Jaccard similarity of the sets of at least ``least``. Classes meet by their hashed words
    (:func:`setjoin.similar_pairs`); the pairs found are verified on the words themselves.

    Null ids, groups and texts and texts without words are in no class. Repeated rows count once.
    Records are read more than once, each time a few columns, so they should be cheap to read again.
    """
    records = records.filter("id IS NOT NULL AND group IS NOT NULL")
    sets = _sets(records)
    hashed = sets.select("group", "id", "key", F.transform("set", lambda w: F.hash(w)).alias("h"))
    one = hashed.groupBy("group", "key").agg(F.min("id").alias("id"), F.first("h").alias("h")).filter(F.size("h") > 0)
    pairs = staged(setjoin.similar_pairs(one, records, least))
    ends = small(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    words = _sets(records.join(ends, "id", "left_semi")).groupBy("group", "id", "key").agg(F.first("set").alias("set"))
    both = pairs.join(words.toDF("group", "a", "ka", "sa"), ["group", "a", "ka"]).join(words.toDF("group", "b", "kb", "sb"), ["group", "b", "kb"])
    k = F.size(F.array_intersect("sa", "sb"))
    links = both.withColumn("similarity", F.round(k / (F.size("sa") + F.size("sb") - k), 6)).filter(F.col("similarity") >= least).select("group", "a", "b", "similarity")
    known = sets.select("group", "id", "key", F.size("set").alias("n")).groupBy("group", "id", "key").agg(F.max("n").alias("n")).filter("n > 0")
    members = known.join(known.groupBy("group", "key").agg(F.min("id").alias("cls")), ["group", "key"]).select("group", "id", "cls").distinct()
    return links, members


def near_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(group, id, cls, n_near)`` of :func:`similar_sets`: each record with its class and the number of other records similar to it."""
    size = members.groupBy("group", "cls").agg(F.count("*").alias("n"))
    ends = links.select("group", F.col("a").alias("cls"), F.col("b").alias("to")).union(links.select("group", "b", "a"))
    far = ends.join(size.select("group", F.col("cls").alias("to"), "n"), ["group", "to"]).groupBy("group", "cls").agg(F.sum("n").alias("far"))
    classes = size.join(far, ["group", "cls"], "left").select("group", "cls", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_near"))
    return members.join(classes, ["group", "cls"]).select("group", "id", "cls", "n_near")


def near_records(wanted: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, other)``: all records similar to those of ``wanted(id)``, of their own class and of linked ones. For few wanted records; it grows with their classes."""
    ends = links.select("group", F.col("a").alias("cls"), F.col("b").alias("to")).union(links.select("group", "b", "a"))
    mine = wanted.select("id").distinct().join(members, "id")
    to = mine.select("id", "group", F.col("cls").alias("to")).union(mine.join(ends, ["group", "cls"]).select("id", "group", "to")).distinct()
    return to.join(members.select("group", F.col("cls").alias("to"), F.col("id").alias("other")), ["group", "to"]).filter("other <> id").select("id", "other").distinct()
