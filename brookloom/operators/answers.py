"""Answers and their sources: labels, excerpts, ranges, extraction, routes, gathering, merging, matching of tokens and clauses.

Lists that belong to one question (hits, labels, sentences of a hit) are bounded by their search; everything over a collection is a
join or an aggregation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.functions import words
from brookloom.operators.sequences import folded

# How labels begin and name their chunk.
HEAD = r"(?:doc|dok|dokument|document|source|quelle)"
LOOSE = rf"(?i)\[{HEAD}\s*:[^\]\n]{{1,300}}\]"
TAIL = r"(?i),\s*(?:chunk|abschnitt|teil|part)\s*(?::\s*)?(\d{1,6})\s*\]$"
SENTENCE = r"[^.!?\n]+(?:[.!?]+[\"')\]]*|\n|$)"


# --- labels -----------------------------------------------------------------------------------------------------------------------


def loose_labels(text: Column) -> Column:
    """Everything in a text that may be meant as a citation."""
    return F.regexp_extract_all(text, F.lit(LOOSE), F.lit(0))


def parsed_label(label: Column) -> Column:
    """(doc, chunk) of a label in any case and spacing; chunk is null where none is named; null for what is no label."""
    t = F.trim(label)
    body = F.regexp_replace(t, rf"(?i)^\[\s*{HEAD}\s*:\s*", "")
    number = F.regexp_extract(body, TAIL, 1)
    name = F.when(number != "", F.regexp_replace(body, TAIL, "")).otherwise(F.regexp_replace(body, r"\s*\]$", ""))
    return F.when(t.rlike(rf"(?i)^\[\s*{HEAD}\s*:.*\]$"), F.struct(F.trim(F.regexp_replace(name, r"\s+", " ")).alias("doc"), F.when(number != "", number.cast("int")).alias("chunk")))


def _norm(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def resolved_labels(labels: DataFrame, sources: DataFrame) -> DataFrame:
    """(label, source) of labels (label) against sources (source, doc, chunk): the same name and chunk, or, without a chunk, the only one of
    that name; null where neither holds."""
    p = labels.select("label", parsed_label(F.col("label")).alias("p")).select("label", _norm(F.col("p.doc")).alias("name"), F.col("p.chunk").alias("at")).distinct()
    s = sources.select("source", _norm(F.col("doc")).alias("name"), "chunk")
    exact = p.filter("at is not null").join(s.withColumnRenamed("chunk", "at"), ["name", "at"], "left").groupBy("label").agg(F.min("source").alias("source"))
    only = s.groupBy("name").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    bare = p.filter("at is null").join(only, "name", "left").select("label", "source")
    return exact.unionByName(bare)


def expanded_labels(text: Column, labels: Column) -> Column:
    """[S1] and lists such as [S1, S3] become the labels of those sources (an array, S1 first); unknown numbers stay."""
    apart = text
    for _ in range(2):  # every second one, then those between
        apart = F.regexp_replace(apart, r"\[(S\d{1,3})\s*[,;]\s*(?=S\d)", "[$1][")
    numbered = F.transform(labels, lambda x, i: F.struct(F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("]")).alias("k"), x.alias("v")))
    return F.aggregate(numbered, apart, lambda t, e: F.replace(t, e["k"], e["v"]))


def nearest_cites(statements: DataFrame, block: list[str], order: str, cite: str) -> DataFrame:
    """Adds ``cited`` and ``cite_source``: a statement's own citation, else that of the next cited statement of its block, else of the one before."""
    after = Window.partitionBy(*block).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy(*block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = F.coalesce(F.first(cite, ignorenulls=True).over(after), F.last(cite, ignorenulls=True).over(before))
    return statements.withColumn("cited", F.coalesce(cite, near)).withColumn("cite_source", F.when(F.col(cite).isNotNull(), "own").when(near.isNotNull(), "block"))


# --- excerpts ---------------------------------------------------------------------------------------------------------------------


def sentence_list(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s) != "")


def scored_sentences(text: Column, terms: list[str] | Column) -> Column:
    """(score, order, text) of the sentences: how many of the terms each holds."""
    want = terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms])
    return F.transform(sentence_list(text), lambda s, i: F.struct(F.size(F.array_intersect(words.tokens(s), want)).alias("score"), i.alias("order"), F.trim(s).alias("text")))


def query_ranges(text: Column, terms: list[str] | Column) -> Column:
    """The sentences with most terms first, those without any last, each group in the order of the text."""
    ranked = F.array_sort(F.transform(scored_sentences(text, terms), lambda s: F.struct((-s["score"]).alias("less"), s["order"].alias("order"), s["text"].alias("text"))))
    return F.transform(ranked, lambda s: s["text"])


def premise(text: Column, terms: list[str], most: int = 3, chars: int = 1200) -> Column:
    """The ``most`` sentences with the most terms, put back into the order of the text, up to ``chars``; the first ones if none has any."""
    ranked = F.array_sort(F.transform(scored_sentences(text, terms), lambda s: F.struct((-s["score"]).alias("less"), s["order"].alias("order"), s["text"].alias("text"))))
    hits = F.filter(ranked, lambda s: s["less"] < 0)
    chosen = F.slice(F.when(F.size(hits) > 0, hits).otherwise(F.filter(ranked, lambda s: s["less"] == 0)), 1, most)
    back = F.array_sort(F.transform(chosen, lambda s: F.struct(s["order"].alias("order"), s["text"].alias("text"))))
    return F.rtrim(F.left(F.array_join(F.transform(back, lambda s: s["text"]), " "), F.lit(chars)))


def extracted_answer(hits: DataFrame, terms: list[str], limit: int, rank: str = "rank", text: str = "text", label: str = "label") -> DataFrame:
    """(sentence, label, score, place): the sentences of ranked hits that share most terms. One that contains or is contained in an earlier
    one of its hit, or equals one of another hit, is left out. Hits are those of one question."""
    scored = F.filter(scored_sentences(F.col(text), terms), lambda s: s["score"] > 0)
    none = F.array().cast("array<struct<score:int,order:int,text:string>>")
    kept = F.aggregate(scored, none, lambda a, s: F.when(F.exists(a, lambda x: x["text"].contains(s["text"]) | s["text"].contains(x["text"])), a).otherwise(F.concat(a, F.array(s))))
    each = hits.select(rank, label, F.explode(kept).alias("s"))
    first = each.groupBy(F.col("s.text").alias("sentence")).agg(F.min(F.struct(rank, "s.order", label, "s.score")).alias("f"))
    best = first.select("sentence", F.col(f"f.{label}").alias("label"), F.col("f.score").alias("score"), F.col(f"f.{rank}").alias("_r"), F.col("f.order").alias("_o"))
    out = best.orderBy(F.desc("score"), "_r", "_o").limit(limit)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "_r", "_o"))).drop("_r", "_o")  # ``limit`` rows


def delivered(context: Column, label: Column, text: Column) -> Column:
    """full, partial or omitted: how much of a source a fenced context (``structured.fenced``) holds."""
    head = F.concat(F.lit("<<source "), label, F.lit(">>\n"))
    at = F.call_function("instr", context, head)
    rest = F.substring(context, at + F.length(head), F.length(context))
    end = F.call_function("instr", rest, F.lit("\n<<end>>"))
    body = F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
    return F.when((at == 0) | (F.trim(body) == ""), "omitted").when(body == text, "full").otherwise("partial")


# Room of a context by the size of the model that reads it: characters in all, in one passage, and passages; up to how many tokens a
# model is small or mid; the least characters of a passage.
PACKS = {"small": (1_800, 600, 3), "mid": (9_600, 1_600, 6), "large": (24_000, 2_400, 12)}
SMALL, MID = 4_096, 16_384
LEAST = 80


def pack_size(context_tokens: int) -> str:
    return "small" if context_tokens <= SMALL else "mid" if context_tokens <= MID else "large"


def fence_free(text: str) -> str:
    """No run of angle or square brackets that could be read as a mark of the pack."""
    return re.sub(r"\]{2,}", "]", re.sub(r"\[{2,}", "[", re.sub(r"<{2,}", "<", re.sub(r">{2,}", ">", text))))


def packed(hits: DataFrame, key: str, rank: str, text: str, ranges: str, size: str = "mid", most_chars: int | None = None) -> DataFrame:
    """(key, rank, label, delivered, line) of ranked hits with their sentences in the order of their fit (``ranges``, see ``query_ranges``): each passage
    gets the sentences that fit into what is left, in the order of its text; full, partial or omitted is said of every hit. A passage of which
    less than LEAST characters would fit is omitted, and later ones may still fit."""
    total, each, passages = PACKS[size]
    total = min(total, most_chars) if most_chars is not None else total

    def step(state: tuple, r: tuple) -> tuple:
        left, n = state
        place, body, sentences = r
        body = body or ""
        head = f"[S{n + 1}] "
        room = min(each, left - len(head) - 1)
        if n >= passages or room < min(LEAST, len(body)) or not body.strip():
            return state, (place, None, "omitted", None)
        if len(body) <= room:
            excerpt, how = body, "full"
        else:
            chosen, used = set(), 0
            for s in sentences if sentences is not None else ():
                if used + len(s) + 1 <= room:
                    chosen.add(s)
                    used += len(s) + 1
            kept = sorted(chosen, key=body.find)
            excerpt, how = " ".join(kept) if kept else body[:room], "partial"
        line = head + fence_free(excerpt)
        return (left - len(line) - 1, n + 1), (place, head.strip(), how, line)

    kind = hits.schema[rank].dataType.simpleString()
    return folded(hits, key, rank, lambda: (total, 0), step, [text, ranges], f"{rank} {kind}, label string, delivered string, line string")


# --- routes and sources -----------------------------------------------------------------------------------------------------------


def names_title(question: Column, title: Column) -> Column:
    """Whether two neighbouring words of the question stand side by side in the title (its ending aside)."""

    def pairs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(w, i), F.try_element_at(w, i + 1)))

    q = words.tokens(question)
    t = F.filter(words.tokens(F.regexp_replace(title, r"(?i)\.[a-z0-9]{1,5}$", "")), lambda w: F.length(w) >= 3)
    return (F.size(q) > 1) & (F.size(t) > 1) & F.arrays_overlap(pairs(q), pairs(t))


def route(mode: Column, attachments: Column, images: Column, documents: Column, named: Column, titled: Column, probed: Column, model_ready: Column) -> Column:
    """(route, reason): an explicit mode, else what the question carries, names, or the probe says (free, mixed, grounded). Without a model the
    sources are quoted, except for images."""
    explicit = (mode != "auto") & mode.isNotNull()
    first = (
        F.when(attachments > 0, F.struct(F.lit("grounded").alias("route"), F.lit("attachment").alias("reason")))
        .when(images > 0, F.struct(F.lit("free").alias("route"), F.lit("images_only").alias("reason")))
        .when(documents == 0, F.struct(F.lit("free").alias("route"), F.lit("no_sources").alias("reason")))
        .when(named, F.struct(F.lit("grounded").alias("route"), F.lit("reference").alias("reason")))
        .when(titled, F.struct(F.lit("grounded").alias("route"), F.lit("title").alias("reason")))
        .otherwise(F.struct(probed.alias("route"), F.when(probed == "grounded", "probe_strong").when(probed == "mixed", "probe_weak").otherwise("probe_none").alias("reason")))
    )
    quoted = ~model_ready & ~((images > 0) & (attachments == 0))
    return (
        F.when(explicit, F.struct(mode.alias("route"), F.lit("explicit_mode").alias("reason")))
        .when(quoted, F.struct(F.lit("grounded").alias("route"), F.lit("no_model").alias("reason")))
        .otherwise(first)
    )


def gathered(lists: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """(label, kind, id, rank): ranked lists (id, rank) of kinds of source, each up to its number, labelled [S1] and on in the order of the lists."""
    parts = [df.filter(F.col("rank") <= most).select(F.lit(k).alias("_k"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "rank") for k, (kind, df, most) in enumerate(lists)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = F.row_number().over(Window.orderBy("_k", "rank", "id"))  # the lists' bounds together
    return out.select(F.concat(F.lit("[S"), n.cast("string"), F.lit("]")).alias("label"), "kind", "id", "rank")


def relevant_series(latest: DataFrame, question: str, most: int) -> DataFrame:
    """The series whose name and source share most words with a question, newer first at equal shares."""
    q = sorted({re.sub("s$", "", w) for w in re.findall(r"[^\W_]{3,}", question.lower())})
    parts = F.concat(F.split("series", "[._]"), F.split("source", "[._-]"))
    own = F.array_distinct(F.transform(F.filter(parts, lambda p: F.length(p) >= 3), lambda p: F.regexp_replace(p, "s$", "")))
    scored = latest.withColumn("score", F.size(F.array_intersect(own, F.array(*[F.lit(x) for x in q]))))
    return scored.filter("score > 0").orderBy(F.desc("score"), F.desc("happened"), "source", "series").limit(most)


def merged_answers(answers: DataFrame, group: str, position: str, most: int = 20) -> DataFrame:
    """(group, source, place): distinct sources (uri) of a group's answers (sources array) in the order in which they appear first, at most ``most``."""
    each = answers.select(group, position, F.posexplode("sources").alias("k", "source"))
    first = each.groupBy(group, "source").agg(F.min(F.struct(position, "k")).alias("f"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("f", "source"))
    return first.select(group, "source", place.alias("place")).filter(F.col("place") <= most)


def shifted_segments(answers: DataFrame, merged: DataFrame, group: str, position: str) -> DataFrame:
    """(group, start, end, sources): segments in the joined text, two characters between answers; references to dropped sources go, and
    segments without any left too. Blank answers take no room."""
    real = answers.filter(F.trim("text") != "")
    w = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    placed = real.withColumn("offset", F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)))
    each = placed.select(group, position, "offset", "sources", F.posexplode("segments").alias("n", "s")).select(group, position, "n", "offset", "s.start", "s.end", F.explode(F.transform("s.sources", lambda i: F.try_element_at("sources", i + 1))).alias("source"))
    kept = each.join(merged, [group, "source"])
    return kept.groupBy(group, position, "n", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end")).agg(F.array_sort(F.collect_set("place")).alias("sources")).drop(position, "n")


# --- matching ---------------------------------------------------------------------------------------------------------------------


def fuzzy_matches(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """(token, candidate): equal ones; of five characters or more those that share a beginning up to four characters short of the longer one, and
    those that contain each other if the longer has eight. Equi-joins on tokens, beginnings and inner parts, never all pairs."""
    t, c = tokens.select("token").distinct(), index.select(F.col("token").alias("candidate")).distinct()
    same = t.join(c, F.col("token") == F.col("candidate"))
    tl, cl = t.filter("length(token) >= 5"), c.filter("length(candidate) >= 5")
    both = tl.withColumn("b", F.left("token", F.lit(5))).join(cl.withColumn("b", F.left("candidate", F.lit(5))), "b").drop("b")
    longest = F.greatest(F.length("token"), F.length("candidate"))
    need = F.greatest(F.lit(5), longest - 4)
    begin = both.filter(F.left("token", need) == F.left("candidate", need))

    def inner(df: DataFrame, col: str) -> DataFrame:
        n = F.length(col)
        starts = F.sequence(F.lit(1), n - 4)
        parts = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(F.lit(5), n - a + 1), lambda m: F.substring(F.col(col), a, m))))
        return df.filter(n >= 8).select(col, F.explode(F.array_distinct(parts)).alias("part"))

    in_candidate = inner(cl, "candidate").join(tl, F.col("part") == F.col("token")).select("token", "candidate")
    in_token = inner(tl, "token").join(cl.filter("length(candidate) >= 8"), F.col("part") == F.col("candidate")).select("token", "candidate")
    return same.unionByName(begin).unionByName(in_candidate).unionByName(in_token).distinct()


def overlap(statement: Column, source: Column) -> Column:
    """The share of a statement's distinct tokens that a source holds; null without tokens."""
    own = F.array_distinct(statement)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, source)) / F.size(own))


def aligned_clauses(statements: DataFrame, clauses: DataFrame, group: str, least: int = 2, forward: float = 0.6, back: float = 0.5) -> DataFrame:
    """(statement, clause, shared): for each statement (group, statement, tokens) the clause of its group (group, clause, tokens) that covers it
    best: ``least`` shared tokens or more, shares of both sides. Joined by token, so only pairs that share something meet."""
    s = statements.select(group, "statement", F.size(F.array_distinct("tokens")).alias("n_s"), F.explode(F.array_distinct("tokens")).alias("token"))
    c = clauses.select(group, "clause", F.size(F.array_distinct("tokens")).alias("n_c"), F.explode(F.array_distinct("tokens")).alias("token"))
    shared = s.join(c, [group, "token"]).groupBy(group, "statement", "clause", "n_s", "n_c").agg(F.count(F.lit(1)).alias("shared"))
    good = shared.filter((F.col("shared") >= least) & (F.col("shared") >= forward * F.col("n_s")) & (F.col("shared") >= back * F.col("n_c")))
    return good.groupBy("statement").agg(F.max_by(F.struct("clause", "shared"), F.struct("shared", -F.col("clause"))).alias("b")).select("statement", "b.*")


# --- graph of statements ----------------------------------------------------------------------------------------------------------


def named_in(name: Column, passage_words: Column) -> Column:
    """Whether all words of a name stand in a passage (its words folded); a name without words stands nowhere."""
    own = F.filter(F.split(words.name_key(name), " "), lambda w: w != "")
    return (F.size(own) > 0) & (F.size(F.array_except(own, passage_words)) == 0)


def checked_triples(triples: DataFrame, passages: DataFrame) -> DataFrame:
    """Triples (doc, chunk, subject, predicate, object) with ``reason``: cite (no such passage), same, subject or object (not named there), or null."""
    p = passages.select("doc", "chunk", "passage_words", F.lit(True).alias("_known"))
    j = triples.join(p, ["doc", "chunk"], "left")
    reason = (
        F.when(F.col("_known").isNull(), "cite")
        .when(words.name_key(F.col("subject")) == words.name_key(F.col("object")), "same")
        .when(~named_in(F.col("subject"), F.col("passage_words")), "subject")
        .when(~named_in(F.col("object"), F.col("passage_words")), "object")
    )
    return j.withColumn("reason", reason).drop("passage_words", "_known")


def batches(chunks: DataFrame, group: str, order: str, size: str, most: int = 6, chars: int = 4000) -> DataFrame:
    """(group, order, batch): chunks of a group dealt into batches of at most ``most`` chunks and ``chars`` characters, in order. The sizes of one
    group are folded as an array: a few bytes for each chunk."""
    listed = chunks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("bigint").alias("c")))).alias("l"))
    start = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("c"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["b"] < 0) | (a["n"] >= most) | (a["c"] + x["c"] > chars)
        b = F.when(new, a["b"] + 1).otherwise(a["b"])
        return F.struct(b.alias("b"), F.when(new, F.lit(1).cast("bigint")).otherwise(a["n"] + 1).alias("n"), F.when(new, x["c"]).otherwise(a["c"] + x["c"]).alias("c"), F.concat(a["out"], F.array(b)).alias("out"))

    dealt = listed.withColumn("b", F.aggregate("l", start, step)["out"])
    return dealt.select(group, F.explode(F.arrays_zip(F.col("l.o").alias("o"), "b")).alias("z")).select(group, F.col("z.o").alias(order), F.col("z.b").alias("batch"))


# --- marks ------------------------------------------------------------------------------------------------------------------------


def fired(items: DataFrame, now: Column, catch_up_min: int) -> DataFrame:
    """Active items that are due: fired, or missed if they are later than the catch-up time."""
    late = F.unix_millis(now) - F.unix_millis("next")
    return items.filter(F.col("active") & (late >= 0)).withColumn("kind", F.when(late > catch_up_min * 60_000, "missed").otherwise("fired"))


def rollbacks(anchors: DataFrame, log: DataFrame) -> DataFrame:
    """(n, reason): anchors (n, seq, hash) that a log (seq, hash) no longer holds: it ends before them, or the record differs."""
    head = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    j = anchors.join(log.select("seq", F.col("hash").alias("now")), "seq", "left").crossJoin(F.broadcast(head))  # one row
    reason = F.when(F.col("head") < F.col("seq"), "head_older").when((F.col("seq") > 0) & ~F.col("hash").eqNullSafe(F.col("now")), "hash_mismatch")
    return j.select("n", reason.alias("reason")).filter("reason is not null")
