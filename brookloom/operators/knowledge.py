"""Relational operators of the knowledge base: visibility, joins, search over sections and documents, keyset paging, ingest."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.functions import words
from brookloom.session import staged


def once(rows: DataFrame, by: str = "id", newest: str = "updated_at") -> DataFrame:
    """Repeated rows of an id become one: the row with the latest time, ties by the row's own values."""
    rest = [c for c in rows.columns if c != by]
    order = F.struct(F.col(newest), F.xxhash64(*[F.col(c) for c in rest]))
    return rows.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(by, "r.*")


def visible(docs: DataFrame, me: str | None) -> DataFrame:
    """Documents that are public or one's own."""
    mine = F.lit(False) if me is None else F.coalesce(F.col("owner_id") == me, F.lit(False))
    return docs.filter(F.coalesce("is_public", F.lit(False)) | mine)


def visible_children(children: DataFrame, docs: DataFrame, me: str | None, key: str = "document_id") -> DataFrame:
    """Rows whose document is visible."""
    return children.join(visible(docs, me).select(F.col("id").alias(key)), key, "left_semi")


def first_sections(sections: DataFrame) -> DataFrame:
    """Each document's first section by index, then time, then id."""
    w = Window.partitionBy("document_id").orderBy("section_index", "created_at", "id")
    return sections.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def with_first_section(docs: DataFrame, sections: DataFrame) -> DataFrame:
    s = first_sections(sections).select(F.col("document_id"), F.col("id").alias("section_id"), "heading", "markdown_content", "section_index")
    return docs.join(s, docs["id"] == s["document_id"], "left").drop("document_id")


def recent(docs: DataFrame, sections: DataFrame, limit: int) -> DataFrame:
    """The sections of the newest documents as hits; a document without sections is its own hit."""
    newest = docs.orderBy(F.desc("created_at"), "id").limit(limit)
    s = sections.select(F.col("document_id").alias("id"), F.col("id").alias("section_id"), "section_index", "heading", "markdown_content")
    joined = newest.select("id", "title", "summary", "raw_content", "created_at").join(s, "id", "left")
    content = F.coalesce("markdown_content", "summary", F.left(F.col("raw_content"), F.lit(2000)))
    return joined.select(F.col("id").alias("document_id"), "title", "section_id", F.coalesce("section_index", F.lit(0)).alias("section_index"), "heading", content.alias("content"))


def keyset_page(rows: DataFrame, after: str, limit: int, missing: Column) -> DataFrame:
    """The next ``limit`` rows after a key for which something is missing, in key order."""
    return rows.filter((F.col("id") > after) & missing).orderBy("id").limit(limit)


def section_payload(sections: DataFrame, dim: int, heading: int = 200, content: int = 20_000) -> DataFrame:
    """Texts clipped to the store's limits; a vector is kept only if it has the right length and finite numbers."""
    good = (F.size("embedding") == dim) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return sections.select(
        "id",
        F.left(F.trim(F.coalesce("heading", F.lit(""))), F.lit(heading)).alias("heading"),
        F.left(F.col("markdown_content"), F.lit(content)).alias("markdown_content"),
        F.when(good, F.col("embedding")).alias("embedding"),
    )


def exploded_payload(payloads: DataFrame) -> DataFrame:
    """(doc_id, position, heading, content) of a JSON array of sections, positions from 1; broken JSON gives no row."""
    schema = "array<struct<heading:string,content:string>>"
    return payloads.select("doc_id", F.posexplode(F.from_json("sections", schema)).alias("position", "s")).select("doc_id", (F.col("position") + 1).alias("position"), "s.heading", "s.content")


# --- search -----------------------------------------------------------------------------------------------------------------------


def lexemes(text: Column) -> Column:
    """Distinct search words of a text, unstemmed: two characters or more, none of the function words of the search."""
    all_words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(words.WORD), F.lit(0))
    return F.array_distinct(F.filter(all_words, lambda w: (F.length(w) > 1) & ~w.isin(words.STOP_SEARCH)))


def search(docs: DataFrame, sections: DataFrame, terms: list[str], limit: int = 6) -> DataFrame:
    """Section and document hits. If any hit holds all terms only such hits stay (strict); else those that share two terms or more.

    Instead of stems and cover density, words count as they are and the rank is the share of the terms held. A document hit gives way
    to hits in its own sections, and without strictness stands only for documents without sections.
    """
    want = F.array(*[F.lit(t) for t in terms])
    n = len(terms)

    def scored(df: DataFrame, text: Column) -> DataFrame:
        return df.withColumn("shared", F.size(F.array_intersect(lexemes(text), want))).filter("shared > 0").withColumn("has_all", F.col("shared") == n)

    s = scored(sections, F.concat_ws(" ", "heading", "markdown_content")).select("id", "document_id", "section_index", "shared", "has_all")
    s = s.join(docs.select(F.col("id").alias("document_id"), "title"), "document_id").select(F.col("id").alias("section_id"), "document_id", "title", "section_index", F.lit(True).alias("is_section"), "shared", "has_all")
    d = scored(docs, F.concat_ws(" ", "title", "summary")).select("id", "title", "shared", "has_all")
    first = first_sections(sections).select(F.col("document_id").alias("id"), F.col("id").alias("section_id"), "section_index")
    d = d.join(first, "id", "left").select("section_id", F.col("id").alias("document_id"), "title", F.coalesce("section_index", F.lit(0)).alias("section_index"), F.lit(False).alias("is_section"), "shared", "has_all")
    hits = staged(s.unionByName(d), "hits")  # scored once; all that follows reads the few rows that share a term
    mode = hits.agg(F.coalesce(F.bool_or("has_all"), F.lit(False)).alias("strict"))
    fits = F.when(F.col("strict"), F.col("has_all")).otherwise((F.col("shared") >= min(2, n)) & (F.col("is_section") | F.col("section_id").isNull()))
    chosen = hits.crossJoin(F.broadcast(mode)).filter(fits).withColumn("score", F.when(F.col("strict"), 1.0).otherwise(F.col("shared") + F.col("shared") / (F.lit(float(n)) + F.col("shared"))))
    taken = chosen.filter("is_section").select("document_id").distinct()
    out = chosen.filter("is_section").unionByName(chosen.filter("not is_section").join(taken, "document_id", "left_anti").select(chosen.columns))
    return out.orderBy(F.desc("score"), "title", "section_index", "document_id").limit(max(1, min(limit, 20))).drop("strict", "has_all")


def websearch(text: Column, query: str) -> Column:
    """Whether a text fits a query as people type it: all words, "phrases" word by word, one side of an or, and none of the -excluded words or
    phrases. Words count as they are; function words outside phrases don't count. A query without words fits nothing."""
    all_words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(words.WORD), F.lit(0))
    line = F.concat(F.lit(" "), F.array_join(all_words, " "), F.lit(" "))
    sides: list[Column] = []
    current: list[Column] = []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            if current:
                sides.append(reduce(lambda x, y: x & y, current))
            current = []
            continue
        own = re.findall(r"[^\W_]+", (phrase or word).lower())
        if not own or (not phrase and own[0] in words.STOP_SEARCH):
            continue
        hit = line.contains(" " + " ".join(own) + " ")
        current.append(~hit if minus else hit)
    if current:
        sides.append(reduce(lambda x, y: x & y, current))
    return reduce(lambda x, y: x | y, sides) if sides else F.lit(False)


# --- chunks -----------------------------------------------------------------------------------------------------------------------


def context_of(chunks: DataFrame, pad: int) -> DataFrame:
    """``pad`` characters around a span (start, end), within the text."""
    start = F.greatest(F.lit(0), F.col("start") - pad)
    end = F.least(F.length("text"), F.col("end") + pad)
    return chunks.withColumn("context", F.substring(F.col("text"), start + 1, end - start))


def duplicates_by_hash(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(sha256, keep, copies): equal texts by hash; the least id is kept."""
    return docs.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha256")).agg(F.min(id_col).alias("keep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
