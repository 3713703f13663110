"""Checks on texts: numbers and their grounds, phrases, audit sums, passages and TF-IDF search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.functions.columns import any_of, lookup
from panelworks.operators import postings
from panelworks.schema import EXCEPTION_LABELS, RULE_LABELS
from panelworks.session import checkpoint

# Phrases that a review note must not use, and those of which it needs one.
CAUSAL = [
    "because the borrower", "because this borrower", "caused by", "the cause of", "due to the borrower", "as a result of the borrower",
    "this means the borrower", "proves that", "demonstrates that the borrower",
]
DECISION = [
    "recommend denial", "recommend denying", "should be denied", "deny the", "approve the loan", "should be approved", "recommend foreclosure",
    "should be foreclosed", "terminate the loan", "should be charged off", "recommend rejection", "reject the",
]
CERTAINTY = [
    "will default", "will certainly", "is guaranteed", "guaranteed to", "definitely will", "certain to default", "will not default", "no risk of",
    "zero risk", "cannot default", "is certain",
]
DISCLAIMER = ["recommendation", "not a decision", "for review", "model estimate", "requires review", "not established causes", "advisory"]
# Dashes and blanks that stand for ASCII ones.
DASHES, BLANKS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "\u00a0\u202f\u2009"
# White space between a number and its sign or percent sign; DuckDB's \s, which has no vertical tab.
_SPACE = r"\t\n\f\r "
#: Stands for a minus sign while numbers are looked for; no text keeps it.
_MINUS = "\ue000"
RELATIVE, ABSOLUTE = 0.02, 1e-6
#: Question terms up to which every task gets all of them.
BROADCAST_ROWS = 1_000_000


def normalise_text(text: Column) -> Column:
    """Typographic dashes and blanks to ASCII; narrow blanks between digits dropped; null is empty."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?<=\d)[{BLANKS}](?=\d)", "")
    return F.translate(plain, DASHES + BLANKS + _MINUS, "-" * len(DASHES) + " " * len(BLANKS))


def extract_numbers(text: Column) -> Column:
    """array of (raw, value, is_percent) in the order of the text, null as empty; commas and currency signs dropped.

    A hyphen is a sign at the beginning and after white space, an opening bracket, colon, comma or equals sign; after
    a letter or digit it parts words.
    """
    signed = F.regexp_replace(normalise_text(text), rf"(^|[{_SPACE}(\[{{:,=])-[{_SPACE}]*(\$?\d)", f"$1{_MINUS}$2")
    found = F.regexp_extract_all(signed, F.lit(rf"({_MINUS}?\$?\d[\d,]*\.?\d*[{_SPACE}]*%?)"), F.lit(1))

    def one(x: Column) -> Column:
        value = F.regexp_replace(x, rf"[,$%{_SPACE}{_MINUS}]", "").try_cast("double")
        minus = F.startswith(x, F.lit(_MINUS))
        return F.struct(F.translate(F.regexp_replace(x, rf"[{_SPACE}]+$", ""), _MINUS, "-").alias("raw"), F.when(minus, -value).otherwise(value).alias("value"), F.contains(x, F.lit("%")).alias("is_percent"))

    return F.filter(F.transform(found, one), lambda n: n["value"].isNotNull())


def _forms(x: Column) -> Column:
    """The ways in which a quantity may be written: itself, rounded, as a percentage if it may be a share; without its sign too."""
    ways = []
    for form in (x, F.abs(x)):
        ways += [form, *[F.round(form, d) for d in range(5)]]
        ways += [F.when(F.abs(form) <= 1, F.round(form * 100, d)) for d in (6, 0, 1, 2, 3)]
    return F.array(*ways)


def numeric_grounding(df: DataFrame, text: str, quantities: Column, literals: Column) -> DataFrame:
    """``df`` with ungrounded (the numbers of ``text`` that the context does not hold, as they stand) and grounded.

    ``quantities`` is an array of the context's figures, which may be rounded, rescaled to percent or off by two in a
    hundred; ``literals`` one of the numbers in its names, dates and identifiers, which must match as they are. Null
    arrays are empty; null entries match nothing.
    """
    near = lambda v, q: (F.abs(v - q) <= ABSOLUTE) | ((q != 0) & (F.abs(v - q) <= RELATIVE * F.abs(q)))
    none = F.array().cast("array<double>")
    known = F.filter(F.flatten(F.transform(F.coalesce(quantities, none), _forms)), lambda x: x.isNotNull())
    rows = df.withColumns({"_known": known, "_exact": F.coalesce(literals, none), "_said": extract_numbers(F.col(text))})

    def held(v: Column) -> Column:
        return F.coalesce(F.exists("_exact", lambda q: F.abs(v - q) <= ABSOLUTE), F.lit(False)) | F.exists("_known", lambda q: near(v, q))

    loose = F.filter("_said", lambda n: ~(held(n["value"]) | (n["is_percent"] & held(n["value"] / 100))))
    return rows.withColumn("ungrounded", F.transform(loose, lambda n: n["raw"])).withColumn("grounded", F.size("ungrounded") == 0).drop("_known", "_exact", "_said")


def literal_numbers(*texts: Column) -> Column:
    """The numbers in names, dates and identifiers, as ``numeric_grounding`` takes them."""
    return F.flatten(F.array(*[F.transform(extract_numbers(t), lambda n: n["value"]) for t in texts]))


def phrase_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """has_causal, has_decision, has_certainty, has_disclaimer, is_empty and cites_number."""
    # A column of its own: inside a lambda the text would be normalised again for each phrase.
    low = F.col("_low")
    hit = lambda ps: any_of([F.contains(low, F.lit(p)) for p in ps])
    return df.withColumn("_low", F.lower(normalise_text(F.col(text)))).withColumns(
        {"has_causal": hit(CAUSAL), "has_decision": hit(DECISION), "has_certainty": hit(CERTAINTY), "has_disclaimer": hit(DISCLAIMER), "is_empty": F.trim(low) == "", "cites_number": low.rlike("[0-9]")}
    ).drop("_low")


def note_checks(df: DataFrame, text: str, quantities: Column, literals: Column) -> DataFrame:
    """``df`` with ok and failed_checks (by name, in order) of every note."""
    rows = numeric_grounding(phrase_flags(df, text), text, quantities, literals)
    has = F.size(F.filter(F.coalesce(quantities, F.array().cast("array<double>")), lambda x: x.isNotNull())) > 0
    tests = {
        "numeric_grounding": F.col("grounded"), "no_causal_claims": ~F.col("has_causal"), "no_decision_language": ~F.col("has_decision"), "no_false_certainty": ~F.col("has_certainty"),
        "carries_disclaimer": F.col("has_disclaimer"), "non_empty": ~F.col("is_empty"), "reports_the_numbers": ~has | F.col("cites_number"),
    }
    failed = F.filter(F.array(*[F.when(~t, F.lit(name)) for name, t in tests.items()]), lambda x: x.isNotNull())
    return rows.withColumn("failed_checks", F.array_join(failed, ",")).withColumn("ok", F.col("failed_checks") == "")


def probability_mismatch(text: Column, expected: Column, tolerance: float = 0.02) -> Column:
    """The stated percentages, as shares, that lie farther than ``tolerance`` from what was expected."""
    stated = F.transform(F.filter(extract_numbers(text), lambda n: n["is_percent"]), lambda n: n["value"] / 100)
    return F.filter(stated, lambda x: F.abs(x - expected) > tolerance)


def audit_summary(log: DataFrame, by: list[str] = ("provider",)) -> DataFrame:
    """By provider: calls, errors, empty outputs, accepted, rejected, rejection rate and median latency (the upper of two).

    ``log`` has provider, accepted, error, output and latency_ms. Calls with an error or an empty output did not reach
    the check and count in no rate.
    """
    failed, empty = F.col("error").isNotNull(), F.trim(F.coalesce("output", F.lit(""))) == ""
    reached = ~failed & ~empty
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    ok = F.coalesce("accepted", F.lit(True))
    out = log.groupBy(*by).agg(
        F.count("*").alias("n_calls"), n(failed).alias("n_errors"), n(~failed & empty).alias("n_empty"), n(reached & ok).alias("n_accepted"), n(reached & ~ok).alias("n_rejected"),
    )
    # The upper median, from counts of latencies.
    counts = log.groupBy(*by, F.coalesce("latency_ms", F.lit(0.0)).alias("_x")).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by)
    upto = counts.withColumns({"_up": F.sum("_n").over(w.orderBy("_x")), "_all": F.sum("_n").over(w)}).where(F.col("_up") > F.floor(F.col("_all") / 2))
    middle = upto.groupBy(*by).agg(F.min("_x").alias("median_latency_ms"))
    reached_n = F.col("n_accepted") + F.col("n_rejected")
    return out.join(middle, list(by)).withColumns({"reached_check": reached_n, "rejection_rate": F.coalesce(F.col("n_rejected") / F.nullif(reached_n, F.lit(0)), F.lit(0.0))})


def rejections_by_check(log: DataFrame) -> DataFrame:
    """(check, n): which checks failed in calls that were rejected; ``log`` has failed_checks, an array, beside the rest."""
    rejected = log.where(F.col("error").isNull() & (F.trim(F.coalesce("output", F.lit(""))) != "") & ~F.coalesce("accepted", F.lit(True)))
    return rejected.select(F.explode("failed_checks").alias("check")).groupBy("check").agg(F.count("*").alias("n"))


def corpus_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", long_line: int = 40) -> DataFrame:
    """(key, line, section, kind, name, passage) of Markdown texts: rows of tables, and lines of more than ``long_line`` characters.

    A row of a table is a passage ``first cell: second cell`` whose name is the first cell; headings of columns and
    rules are left out. A section is the last heading above, or null. Lines are numbered from 0; null texts have none.
    """
    # Texts are dealt by key, not their lines: the window needs no other shuffle, and a file of few blocks is split by many tasks.
    # Their number is fixed, as lines are many times the compressed texts by whose size Spark would put tasks together.
    dealt = docs.select(key, text).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    lines = dealt.select(key, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("line", "_l")).withColumn("_l", F.trim("_l")).where("_l <> ''")
    # What a line is gets decided below the window: a condition above a projection would work out its columns once more for each mention.
    heading = F.startswith("_l", F.lit("#"))
    is_table = F.startswith("_l", F.lit("|")) & (F.length("_l") - F.length(F.replace("_l", F.lit("|"), F.lit(""))) >= 3)
    prose = ~F.startswith("_l", F.lit(">")) & (F.length("_l") > long_line)
    kinds = lines.select(key, "line", "_l", F.when(heading, F.trim(F.ltrim("_l", F.lit("#")))).alias("_title"), F.when(is_table, F.btrim("_l", F.lit("|"))).alias("_inner"), prose.alias("_prose"))
    cell = lambda i: F.trim(F.substring_index(F.substring_index("_inner", "|", i), "|", -1))
    cells = kinds.select(key, "line", "_l", "_title", F.col("_inner").isNotNull().alias("_table"), "_prose", cell(1).alias("_first"), F.when(F.contains("_inner", F.lit("|")), cell(2)).alias("_second"))
    rows = cells.withColumn("section", F.last("_title", ignorenulls=True).over(W.partitionBy(key).orderBy("line"))).where("_title IS NULL")
    row = F.col("_second").isNotNull() & (F.translate("_first", "-: ", "") != "") & ~F.lower("_first").isin("field", "column", "name")
    return rows.where(row | (~F.col("_table") & F.col("_prose"))).select(
        key, "line", "section", F.when(row, "field").otherwise("prose").alias("kind"), F.when(row, F.col("_first")).alias("name"), F.when(row, F.concat("_first", F.lit(": "), "_second")).otherwise(F.col("_l")).alias("passage")
    )


def rule_passages(rules: DataFrame) -> DataFrame:
    """(name, passage) of rule declarations, one passage each."""
    said = F.concat("rule_id", F.lit(": "), F.coalesce("description", F.lit("")), F.lit(" (severity: "), F.coalesce("severity", F.lit("")), F.lit(")"))
    return rules.select(F.col("rule_id").alias("name"), said.alias("passage"))


def review_context(df: DataFrame, p: str, flags: list[str], n_risky: int = 10, n_flagged: int = 10) -> DataFrame:
    """(row_id, queue, context): one JSON text for each row of the review queue, with computed values only.

    The queue is the ``n_risky`` rows of the highest ``p`` and the first ``n_flagged`` (by row_id) that a rule covers; a
    row in both comes once. ``df`` has covered, assigned (the type), anomaly_score and top_drivers beside the flags.
    """
    risky = df.where(F.col(p).isNotNull()).orderBy(F.desc(p), "row_id").limit(n_risky).withColumn("queue", F.lit("risky"))
    flagged = df.where("covered").orderBy("row_id").limit(n_flagged).withColumn("queue", F.lit("flagged"))
    both = risky.unionByName(flagged)
    # At most n_risky + n_flagged rows.
    both = both.withColumn("_n", F.row_number().over(W.partitionBy("row_id").orderBy(F.desc("queue")))).where("_n = 1")
    broken = F.filter(F.array(*[F.when(F.col(r), F.lit(RULE_LABELS.get(r, r.replace("_", " ")))) for r in flags]), lambda x: x.isNotNull())
    context = F.struct(
        "loan_id", F.date_format("reporting_month", "yyyy-MM-dd").alias("reporting_month"), "current_status",
        F.struct(F.round(p, 5).alias("next_3m_delinquency")).alias("predictions"), F.split("top_drivers", "; ").alias("top_drivers"),
        F.struct(F.round("anomaly_score", 4).alias("score")).alias("anomaly"),
        F.struct(
            F.col("covered").alias("required"), F.coalesce(lookup(EXCEPTION_LABELS, F.col("assigned")), F.col("assigned")).alias("type"),
            F.when(F.col("covered"), "rule").otherwise("model score").alias("decided_by"), broken.alias("rules_broken"),
        ).alias("exception"),
    )
    return both.select("row_id", "queue", F.to_json(context).alias("context"))


def _bags(df: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """(key, h): sorted 64-bit hashes of unigrams and bigrams of lower-case ASCII words of two characters or more.

    A key has one row as a rule; those of several are put together, and the second result is false.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z0-9]{2,})"), F.lit(1))
    hashed = df.select(key, words.alias("w")).select(key, F.transform("w", lambda w: F.xxhash64(w)).alias("u"))
    pairs = F.transform(F.slice("u", F.lit(2), F.greatest(F.size("u") - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get("u", i), x))
    rows = hashed.select(key, F.sort_array(F.concat("u", pairs)).alias("h"))
    if df.groupBy(key).count().where("count > 1").isEmpty():
        return rows, True
    return rows.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("h"))).alias("h")), False


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides: sizes behind checkpoints and Python steps are guesses, by which Spark would bring a
    table of any size to the driver to broadcast it."""
    return left.hint("merge").join(right, on, how)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def tfidf_search(docs: DataFrame, questions: DataFrame, least: float = 0.12, top: int = 3, name: str | None = None) -> DataFrame:
    """(item_id, doc_id, score, rank): passages of the highest cosine for each question.

    Sublinear tf, smooth idf over ``docs``, unit vectors; norms take all terms of a passage. With ``name``, a column of
    ``docs``, a passage that has one is found only by a question that says a word of it; it is looked for among the
    5 * top (10 at least) of the highest cosine.

    Terms are 64-bit hashes, and texts are read again for each pass: only terms that questions have leave their task.
    Document frequencies of all others are bounded by a sketch, so each cosine lies between two bounds; passages that
    these leave to the first places get exact weights. Questions of the same terms are looked up once.
    """
    bags, whole = _bags(docs, "doc_id")
    wanted = max(5 * top, 10) if name else top
    sure = 1 - 1e-9
    asked = checkpoint(_bags(questions, "item_id")[0].withColumn("asked_id", F.min("item_id").over(W.partitionBy("h"))))
    q_tf = asked.where("item_id = asked_id").select("asked_id", F.explode("h").alias("term")).groupBy("asked_id", "term").agg(F.count("*").alias("c"))
    q_tf = checkpoint(q_tf)
    slots = postings.slots(q_tf)
    known, buckets, n = postings.sketch(bags, slots)
    n = n if whole else docs.count()
    idf = lambda df: (F.ln(F.lit(1 + n) / (1 + df)) + 1)
    q = _met(q_tf, known, "term").select("asked_id", "term", "df", idf(F.col("df")).alias("idf"), ((1 + F.ln("c")) * idf(F.col("df"))).alias("qw"))
    # What a term adds to a cosine is at most its weight in the question times its highest in any passage, both of unit
    # length. The commonest terms that together stay below half of ``least`` make no candidate.
    tops = postings.shares(bags, "doc_id", slots, buckets, n).groupBy("term").agg(F.max(F.col("tf") / F.col("low")).alias("_top"))
    q = _met(q, tops, "term").withColumn("qn", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(W.partitionBy("asked_id"))))
    w = W.partitionBy("asked_id").orderBy(F.desc("df"), "term")
    by_length = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(w)) / F.col("qn")
    by_terms = F.sum(F.col("qw") / F.col("qn") * F.least(F.col("_top") * F.col("idf"), F.lit(1.0))).over(w)
    q = q.withColumn("_upto", F.least(by_length, by_terms)).withColumn("only", F.col("_upto") < F.lit(least / 2))
    q = checkpoint(q.withColumn("light", F.max(F.when(F.col("only"), F.col("_upto")).otherwise(0.0)).over(W.partitionBy("asked_id"))))
    makes = q.where("NOT only").select("asked_id", "term", "light", (F.col("idf") * F.col("qw") / F.col("qn")).alias("_w"))
    if makes.count() <= BROADCAST_ROWS:
        bounds = postings.bounds(bags, "doc_id", makes, buckets, n, least * sure)
    else:
        found = _met(postings.shares(bags, "doc_id", postings.slots(makes.select("term")), buckets, n), makes, "term").groupBy("asked_id", "doc_id").agg(
            F.sum(F.col("tf") * F.col("_w")).alias("dot"), F.max("low").alias("low"), F.max("high").alias("high"), F.max("light").alias("light")
        )
        bounds = found.select("asked_id", "doc_id", (F.col("dot") / F.col("high")).alias("at_least"), (F.col("dot") / F.col("low") + F.col("light")).alias("at_most"))
        bounds = bounds.where(F.col("at_most") >= F.lit(least * sure))
    bounds = checkpoint(bounds)
    # No passage whose cosine must lie below that of ``wanted`` others is looked at further.
    best = bounds.withColumn("_r", F.row_number().over(W.partitionBy("asked_id").orderBy(F.desc("at_least"), "doc_id"))).where(F.col("_r") <= wanted)
    bar = best.where(F.col("_r") == wanted).select("asked_id", (F.col("at_least") * sure).alias("_bar"))
    near = checkpoint(_met(bounds, bar, "asked_id", "left").where(F.col("_bar").isNull() | (F.col("at_most") >= F.col("_bar"))).select("asked_id", "doc_id"))
    # A filter of fixed size lets these passages pass, and few others, which no pair asks for.
    looked = postings.slots(near.select(F.xxhash64("doc_id").alias("term")))
    tf = checkpoint(postings.counts(bags, "doc_id", looked))
    weights = _met(tf, postings.document_frequencies(bags, postings.slots(tf)), "term").select("doc_id", "term", ((1 + F.ln("c")) * idf(F.col("df"))).alias("w"))
    d = checkpoint(weights.withColumn("dn", F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))))
    dots = _met(_met(near, q.select("asked_id", "term", "qw", "qn"), "asked_id"), d, ["doc_id", "term"]).groupBy("asked_id", "doc_id")
    scored = dots.agg((F.sum(F.col("w") * F.col("qw")) / F.max("qn") / F.max("dn")).alias("score")).where(F.col("score") >= least)
    first = lambda of: F.row_number().over(W.partitionBy(of).orderBy(F.desc(F.round("score", 9)), "doc_id"))
    scored = scored.withColumn("_r", first("asked_id")).where(F.col("_r") <= wanted)
    scored = _met(scored, asked.select("asked_id", "item_id"), "asked_id").select("item_id", "doc_id", "score")
    if name:
        scored = _met(scored, docs.select("doc_id", _tokens(F.col(name)).alias("_name")), "doc_id")
        scored = _met(scored, questions.select("item_id", _tokens(F.regexp_replace("text", "[^A-Za-z0-9_]+", " ")).alias("_asked")), "item_id")
        scored = scored.where((F.size("_name") == 0) | F.arrays_overlap("_name", "_asked")).drop("_name", "_asked")
    return scored.withColumn("rank", first("item_id")).where(F.col("rank") <= top)


NOT_COVERED = "The provided documentation does not cover this."


def answer_lookup(questions: DataFrame, hits: DataFrame, docs: DataFrame, source: Column | None = None) -> DataFrame:
    """(item_id, doc_id, covered, answer, citations): the best passage of each question as it stands, or that there is none.

    Citations name all hits in order: ``source``, by default the doc_id.
    """
    told = docs.select("doc_id", F.col("text").alias("_text"), (source if source is not None else F.col("doc_id").cast("string")).alias("_source"))
    rows = _met(hits, told, "doc_id").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "_text", "_source"))).alias("h"))
    best = rows.select("item_id", F.get("h", 0)["doc_id"].alias("doc_id"), F.get("h", 0)["_text"].alias("_answer"), F.array_join(F.transform("h", lambda x: x["_source"]), "; ").alias("_cited"))
    out = _met(questions.select("item_id"), best, "item_id", "left").withColumn("covered", F.col("doc_id").isNotNull())
    return out.select("item_id", "doc_id", "covered", F.when(F.col("covered"), F.col("_answer")).otherwise(NOT_COVERED).alias("answer"), F.coalesce("_cited", F.lit("")).alias("citations"))
