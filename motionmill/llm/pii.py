"""Personal data: fixed kinds by pattern, further terms by what they disclose, in DataFrame functions only.

Base kinds are found by pattern and checked (parts of an ip, Luhn sum of a card, digits of a phone). Each value found
is an entity. Words that stand within ``REACH`` characters of its mentions are counted over the whole corpus: with
``n_ct`` of a term's ``n_t`` occurrences beside an entity that is mentioned ``n_c`` times among ``N`` words,

    disclosure = log2(n_ct * N / (n_t * n_c)) / log2(N / n_c)

is the share of the entity's information that the term gives away: 1 for a term that stands nowhere else. The same is
counted by whole texts: ``n_ct`` texts with both, of ``n_t`` with the term and ``n_c`` with the entity among ``N``
texts. A term with at least ``SUPPORT`` such occurrences, or different texts, and a disclosure of ``DISCLOSURE`` or more
is telling, and is a ``term`` span wherever it stands in any text. ``sanitise`` replaces base spans by their kind,
generalises capitalised terms to ``[NAME]`` and removes other terms.

Null texts count as empty, offsets are code points, ends are exclusive. Spans of one text depend on that text and the
corpus counts only, so repeated rows agree; a null id stays null. Other columns are kept by ``sanitise`` and ignored
elsewhere.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motionmill.llm._shared import table, written

#: Patterns with the same leftmost, non-overlapping matches as the stated ones, written so that they never backtrack
#: over a long run: a run of word signs or digits is entered at its start, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to match at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BEFORE, AFTER = r"(?<![^\s\"'(\[])", r"(?=[.,;:!?)\]\"']*+(?:\s|$))"
WORD = BEFORE + r"\p{L}{3,}" + AFTER
REACH = 80
SUPPORT = 3
DISCLOSURE = 0.9
#: Telling terms up to this number are sent to every task, more meet the texts' words by an exchange.
BROADCAST_TERMS = 500_000


def _places(text: Column, hits: Column, pattern: str | Column) -> Column:
    """Array of (value, start, end) of ``hits``, all matches of ``pattern`` in ``text``: lengths of what lies between them."""
    gaps = F.split(text, pattern, -1)
    sized = F.transform(hits, lambda h, i: F.struct(h.alias("v"), F.length(F.get(gaps, i)).alias("gap"), F.length(h).alias("n")))
    empty = F.expr("cast(array() as array<struct<value:string,start:int,end:int>>)")
    done = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["n"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct(s["v"].alias("value"), (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["n"]).alias("end"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(hits) > 0, done).otherwise(empty)


def _luhn(digits: Column) -> Column:
    def weigh(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), weigh), F.lit(0), lambda a, b: (a + b).cast("int"))
    return total % 10 == 0


def _labelled(kind: str, span: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), span["value"].alias("value"), span["start"].alias("start"), span["end"].alias("end"))


def _holds(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    digits = F.translate(value, " -().+", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii_base``: array of (kind, value, start, end) by kind as listed, then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    hits = {
        f"pii_{k}": F.when(F.contains(body, F.lit(HINTS[k])) if HINTS[k] else F.lit(True), F.regexp_extract_all(body, F.lit(p), F.lit(0))).otherwise(none)
        for k, p in PATTERNS.items()
    }
    placed = {f"pii_{k}": F.filter(_places(body, F.col(f"pii_{k}"), p), partial(_holds, k)) for k, p in PATTERNS.items()}
    labelled = [F.transform(f"pii_{k}", partial(_labelled, k)) for k in PATTERNS]
    return df.withColumns(hits).withColumns(placed).withColumn("pii_base", F.concat(*labelled)).drop(*hits)


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(F.regexp_replace(span["value"], r"[^0-9.]", ""))
    return F.concat(span["kind"], F.lit(":"), plain)


def _shifted(offset: Column, word: Column) -> Column:
    return F.struct(F.lower(word["value"]).alias("value"), (word["start"] + offset).alias("start"), (word["end"] + offset).alias("end"))


def _mentions(text: Column, base: Column) -> Column:
    """For each base span, its entity and the words around it: array of (entity, words(value, start, end))."""

    def around(s: Column) -> Column:
        begin = F.greatest(s["start"] - REACH, F.lit(0))
        left = F.substr(text, begin + 1, s["start"] - begin)
        cut = F.when(begin > 0, F.length(F.regexp_extract(left, r"^\S*", 0))).otherwise(0)
        right = F.substr(text, s["end"] + 1, F.lit(REACH))
        right = F.when(F.length(right) == REACH, F.regexp_replace(right, r"(?<!\S)\S+$", "")).otherwise(right)
        sides = []
        for side, offset in ((F.substr(left, cut + 1), begin + cut), (right, s["end"])):
            words = _places(side, F.regexp_extract_all(side, F.lit(WORD), F.lit(0)), WORD)
            sides.append(F.transform(words, partial(_shifted, offset)))
        return F.struct(_entity(s).alias("entity"), F.concat(*sides).alias("words"))

    return F.transform(base, around)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def term_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_t, texts) over all texts: occurrences, and texts with the term."""
    words = F.array_sort(F.transform(_words(F.coalesce(F.col(text), F.lit(""))), F.lower))
    sized = df.select(words.alias("words")).select(F.explode(F.transform("words", lambda w, i: F.struct(w.alias("term"), ((i == 0) | (w != F.get("words", i - 1))).cast("int").alias("first")))).alias("w"))
    return sized.groupBy(F.col("w.term").alias("term")).agg(F.count(F.lit(1)).alias("n_t"), F.sum("w.first").alias("texts"))


def _telling(counts: DataFrame, disclosure: float) -> DataFrame:
    """Terms of ``counts`` (term, n_ct, n_t, n_c, total) with the disclosure asked for."""
    share = F.log2(F.col("n_ct") * F.col("total") / (F.col("n_t") * F.col("n_c"))) / F.log2(F.greatest(F.col("total") / F.col("n_c"), F.lit(2.0)))
    return counts.where(F.round(share, 9) >= disclosure).select("term")


def _telling_terms(rows: DataFrame, n_t: DataFrame, support: int, disclosure: float) -> DataFrame:
    """(term): what tells of an entity by what stands beside it, or by the texts that hold both; a row per term."""
    mentions = rows.select(F.explode("mentions").alias("m")).select("m.entity", "m.words")
    n_c = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    n_ct = mentions.select("entity", F.inline("words")).groupBy("entity", F.col("value").alias("term")).agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= support)
    total = n_t.agg(F.coalesce(F.sum("n_t"), F.lit(0)).cast("double").alias("total"))  # one row
    beside = _telling(n_ct.join(n_t, "term").join(n_c, "entity").crossJoin(F.broadcast(total)), disclosure)

    # copies of a text are counted, but are no support of their own
    texts = rows.where(F.size("base") > 0).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("mentions.entity").alias("entities"), F.first("words").alias("words"))
    holds = texts.select("key", "copies", F.explode(F.array_distinct("entities")).alias("entity"))
    n_c = written(holds.groupBy("entity").agg(F.sum("copies").alias("n_c"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= support).drop("support"), "pii-entities")
    pairs = holds.join(n_c.select("entity"), "entity").join(texts.select("key", "words"), "key").select("entity", "copies", F.explode("words").alias("term"))
    n_ct = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_ct"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)
    total = rows.agg(F.count(F.lit(1)).cast("double").alias("total"))  # one row
    within = _telling(n_ct.join(n_t.select("term", F.col("texts").alias("n_t")), "term").join(n_c, "entity").crossJoin(F.broadcast(total)), disclosure)
    return beside.unionByName(within).distinct()


def find_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, key, base) for every row of ``df``; (key, terms) for texts with disclosing terms.

    ``key`` is the text's digest; ``terms`` is a sorted array of (start, end).
    """
    texts = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("pii_text")).withColumn("key", _digest(F.col("pii_text")))
    found = with_base_spans(texts, "pii_text")
    words = F.when(F.size("pii_base") > 0, F.array_distinct(F.transform(_words(F.col("pii_text")), F.lower)))
    rows = written(found.select("doc_id", "key", F.col("pii_base").alias("base"), _mentions(F.col("pii_text"), F.col("pii_base")).alias("mentions"), words.alias("words")), "pii-base")
    telling = written(_telling_terms(rows, written(term_counts(df, text), "pii-terms"), support, disclosure), "pii-telling")
    few = telling.count() <= BROADCAST_TERMS
    telling = F.broadcast(telling) if few else telling
    # a match ends where its run of letters ends, so the order of the forms does not matter
    pattern = lambda form: F.concat(F.lit(BEFORE + "(?:"), form, F.lit(")" + AFTER))
    if few:  # texts stay where they are read
        shown = texts.select("key", "pii_text", F.explode(F.array_distinct(_words(F.col("pii_text")))).alias("form"))
        shown = shown.withColumn("term", F.lower("form")).join(telling, "term").withColumn("pattern", pattern(F.col("form")))
    else:
        forms = texts.select("key", F.explode(F.array_distinct(_words(F.col("pii_text")))).alias("form")).withColumn("term", F.lower("form")).join(telling, "term")
        held = written(forms.groupBy("key").agg(F.collect_set("form").alias("forms")), "pii-forms")
        shown = texts.select("key", "pii_text").join(held, "key").withColumn("pattern", pattern(F.array_join("forms", "|")))
    shown = shown.withColumn("hits", F.regexp_extract_all("pii_text", F.col("pattern"), F.lit(0)))
    spans = shown.select("key", F.inline(_places(F.col("pii_text"), F.col("hits"), F.col("pattern")))).select("key", "start", "end")
    # a word that touches a base span ends there
    beside = rows.select("key", F.explode("mentions.words").alias("words")).select("key", F.inline("words")).withColumnRenamed("value", "term")
    spans = spans.unionByName(beside.join(telling, "term").select("key", "start", "end")).groupBy("key", "start", "end").agg(F.lit(1).alias("one"))
    terms = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("terms"))
    return rows.select("doc_id", "key", "base"), terms


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``df`` with base spans and disclosing terms of ``text`` replaced; all other columns and rows as they are."""
    _, terms = find_spans(df, doc_id, text, support, disclosure)
    terms = written(terms, "pii-spans").withColumnsRenamed({"key": "pii_key", "terms": "pii_terms"})
    held = f"row.`{text}`"  # rows are one struct, so that no column meets a name of ours
    named = with_base_spans(df.select(F.struct("*").alias("row")), held)
    joined = named.withColumn("pii_key", _digest(F.col(held))).join(terms, "pii_key", "left")
    body = F.col(held)
    shown = F.transform("pii_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    named_term = lambda s: F.when(F.substr(body, s["start"] + 1, F.lit(1)).rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit(""))
    hidden = F.transform(F.coalesce("pii_terms", F.expr("cast(array() as array<struct<start:int,end:int>>)")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), named_term(s).alias("label")))
    spans = F.array_sort(F.concat(shown, hidden))
    folded = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substr(body, acc["at"] + 1, s["start"] - acc["at"]), s["label"]))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(body, acc["at"] + 1)),
    )
    clean = F.when(F.size(spans) > 0, folded).otherwise(body)
    return joined.select(*[(clean if c == text else F.col("row").getField(c)).alias(c) for c in df.columns])


def _listed(spans: Column, kind: str | None = None) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind) if kind else s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, terms = find_spans(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    none = F.expr("cast(array() as array<string>)")
    return rows.join(terms, "key", "left").select(
        "doc_id", *[n(k) for k in PATTERNS], F.sha2(F.array_join(_listed(F.col("base")), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(_listed(F.col("base")), F.coalesce(_listed(F.col("terms"), "term"), none)), ",").alias("spans"),
    )
