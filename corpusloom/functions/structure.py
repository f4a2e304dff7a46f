"""Structure of Markdown and legal text: headings, sections, citation keys, as column functions.

A document's lines become rows; which of them are headings is told by patterns, and the
sequential rules (an article must follow the last one, a clause the last clause) are folds over
the few candidate lines. Offsets count code points from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.shared import stored

#: Patterns of heading lines.
CHAPTER = r"(?U)^(?:Chương|CHƯƠNG)\s+([IVXLC\d]+)\b[.:]?\s*(.*)$"
SECTION = r"(?U)^(?:Mục|MỤC)\s+(\d+[A-Za-z]?)\b[.:]?\s*(.*)$"
ARTICLE = r"(?U)^(?:Điều|ĐIỀU)\s+(\d+)([a-zđ]?)\s*[.:]\s*(.*)$"
APPENDIX = r"(?U)^[|\s]*(?:\(Kèm theo\b|(?:Phụ lục|PHỤ LỤC)\b(?!.*\b(?:này|ban hành|kèm theo)\b))"
CLAUSE = r"(?U)^(\d{1,2})\.\s+(.*)$"
POINT = r"(?U)^([a-zđ])\)\s+(.*)$"
SENTENCE_END = ".;:!?\"”"
MARKDOWN = r"(?U)^(#{1,6})\s+(.+)$"
#: Names of document types and the number codes that fit them, by place in the text.
TYPE_CODES = {
    "THÔNG TƯ": ("TT",),
    "NGHỊ ĐỊNH": ("NĐ",),
    "NGHỊ QUYẾT": ("NQ", "QH"),
    "QUYẾT ĐỊNH": ("QĐ",),
    "PHÁP LỆNH": ("PL", "UBTVQH"),
    "LUẬT": ("QH",),
}


def line_rows(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row for each line that is not blank: keys, number, start, stop, line (stripped).

    Offsets are running sums over a text's lines, so the work is linear in the text.
    """
    rows = texts.select(*keys, F.posexplode(F.split(text_col, "(?<=\n)")).alias("number", "raw"))
    before = Window.partitionBy(*keys).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).cast("int"))
    return placed.select(*keys, "number", "start", (F.col("start") + F.length("raw")).alias("stop"), T.strip(F.col("raw")).alias("line")).filter("line <> ''")


def _line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return line_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text")


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, level (chuong, muc, dieu, phuluc), number, title, start of each heading, in order.

    Articles count up from the last one by 1 to 10, or repeat its number with a letter; one that
    does not follow by 1 must come after a finished sentence or a title in capitals. Nothing after
    an appendix line is an article.
    """
    own = Window.partitionBy("id").orderBy("number")
    rows = _line_rows(docs, id_col, text_col)
    kind = (
        F.when(F.rlike("line", F.lit(CHAPTER)), "chuong").when(F.rlike("line", F.lit(SECTION)), "muc").when(F.rlike("line", F.lit(ARTICLE)), "dieu")
    )
    rows = rows.withColumns({"kind": kind, "appendix": F.rlike("line", F.lit(APPENDIX)) & (F.length("line") <= 200)})
    before, before_kind = F.lag("line").over(own), F.lag("kind").over(own)
    previous = F.when(before.isNull() | before_kind.isNotNull(), "").otherwise(before)
    upper = (F.upper(previous) == previous) & (F.lower(previous) != previous)
    rows = rows.withColumn("after_end", (previous == "") | F.substring(previous, -1, 1).isin(*SENTENCE_END) | upper)
    # The line after a bare article heading, within the next three, gives it its title.
    follow = [F.lead("line", k).over(own) for k in (1, 2, 3)]
    follow_number = F.lead("number", 1).over(own)
    plain = lambda c: ~F.rlike(c, F.lit(ARTICLE)) & ~F.rlike(c, F.lit(CHAPTER)) & ~F.rlike(c, F.lit(CLAUSE)) & (F.length(c) < 200)
    rows = rows.withColumn("next_title", F.when((follow_number - F.col("number") <= 3) & plain(follow[0]), follow[0]).otherwise(""))
    found = rows.filter("kind is not null or appendix")
    get = lambda p, i: F.regexp_extract("line", p, i)
    found = found.select(
        "id",
        F.struct(
            "number", "start", "kind", "appendix", "after_end", "line", "next_title", (F.length("line") < 200).alias("short"),
            F.when(F.col("kind") == "dieu", get(ARTICLE, 1).cast("int")).alias("value"),
            F.when(F.col("kind") == "dieu", get(ARTICLE, 2)).when(F.col("kind") == "chuong", get(CHAPTER, 1)).when(F.col("kind") == "muc", get(SECTION, 1)).alias("label"),
            F.when(F.col("kind") == "dieu", get(ARTICLE, 3)).when(F.col("kind") == "chuong", get(CHAPTER, 2)).when(F.col("kind") == "muc", get(SECTION, 2)).alias("title"),
        ).alias("c"),
    )
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("all"))
    kept = "array<struct<level:string,number:string,title:string,start:int>>"
    state = F.struct(F.lit(0).alias("last"), F.lit(False).alias("open"), F.array().cast(kept).alias("kept"))

    def step(s: Column, c: Column) -> Column:
        sequential = ((c["value"] > s["last"]) & (c["value"] <= s["last"] + 10)) | ((c["label"] != "") & (c["value"] == s["last"]))
        article = (c["kind"] == "dieu") & sequential & c["short"] & ((c["value"] == s["last"] + 1) | c["after_end"])
        form = c["appendix"] & ~s["open"] & (F.size(s["kept"]) > 0)
        level = F.when(form, "phuluc").when(s["open"], F.lit(None)).when(article, "dieu").when(c["kind"].isin("chuong", "muc") & c["short"], c["kind"])
        number = F.when(form, "").when(level == "dieu", F.concat(c["value"].cast("string"), c["label"])).otherwise(c["label"])
        bare = (level == "dieu") & (c["title"] == "")
        title = F.when(form, F.substring(F.regexp_replace(c["line"], r"^[| ]+|[| ]+$", ""), 1, 120)).when(bare, c["next_title"]).otherwise(T.strip(c["title"]))
        new = F.struct(level.alias("level"), number.alias("number"), title.alias("title"), c["start"].alias("start"))
        return F.struct(
            F.when(level == "dieu", c["value"]).otherwise(s["last"]).alias("last"),
            (s["open"] | form).alias("open"),
            F.when(level.isNotNull(), F.concat(s["kept"], F.array(new).cast(kept))).otherwise(s["kept"]).alias("kept"),
        )

    folded = listed.select("id", F.explode(F.aggregate("all", state, step)["kept"]).alias("h"))
    return folded.select(F.col("id").alias(id_col), "h.*")


def _section_ranges(texts: DataFrame) -> DataFrame:
    """doc, part, path, start, stop, cuttable of each section of texts (doc, text) with two articles at least."""
    heads = headings(texts, "doc", "text")
    own, n = Window.partitionBy("doc").orderBy("start"), Window.partitionBy("doc")
    label = lambda word: F.concat(F.lit(word + " "), F.col("number"), F.when(F.col("title") != "", F.concat(F.lit(". "), F.col("title"))).otherwise(""))
    at = lambda level, value: F.last(F.when(F.col("level") == level, value), ignorenulls=True).over(own)
    x = heads.withColumns(
        {
            "articles": F.count_if(F.col("level") == "dieu").over(n),
            "chapter": at("chuong", F.struct("start", label("Chương").alias("name"))),
            "part": at("muc", F.struct("start", label("Mục").alias("name"))),
            "stop": F.lead("start").over(own),
        }
    ).filter("articles >= 2")
    part = F.when(F.col("part.start") > F.coalesce("chapter.start", F.lit(-1)), F.col("part.name"))
    form = F.col("level") == "phuluc"
    body = x.filter(F.col("level").isin("dieu", "phuluc")).select(
        "doc",
        F.when(form, "phu-luc").otherwise(F.concat(F.lit("dieu-"), T.make_key(F.col("number")))).alias("part"),
        F.when(form, F.array(F.lit("Phụ lục"))).otherwise(F.array_compact(F.array("chapter.name", part, label("Điều")))).alias("path"),
        "start", F.when(~form, F.col("stop")).alias("stop"), (~form).alias("cuttable"),
    )
    opening = x.groupBy("doc").agg(F.lit("mo-dau").alias("part"), F.array(F.lit("Mở đầu")).alias("path"), F.lit(0).alias("start"), F.min("start").alias("stop"), F.lit(False).alias("cuttable"))
    whole = body.unionByName(opening).join(texts.select("doc", F.length("text").alias("n")), "doc")
    return whole.withColumn("stop", F.coalesce("stop", "n")).drop("n").filter("stop > start")


def _pieces(ranges: DataFrame, texts: DataFrame) -> DataFrame:
    return ranges.join(texts, "doc").withColumn("piece", F.expr("substring(text, start + 1, stop - start)")).drop("text")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, cite part, path, start, stop and text of each section of a legal text.

    One section for each article, one before the first heading (``mo-dau``) and one for the
    appendix; documents with fewer than two articles give none.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = _pieces(_section_ranges(texts), texts).withColumn("text", T.strip(F.col("piece")))
    return found.filter("text <> ''").select(F.col("doc").alias(id_col), "part", "path", "start", "stop", "text")


def _cut(pieces: DataFrame, limit: int, pattern: str, number: Column, key: str, word: str, head_joins: bool) -> DataFrame:
    """Cuttable pieces over ``limit`` characters parted at their numbered lines 1, 2, 3 ...

    ``number``: of a line's label (``label``). What stands before the first is joined to it, or is a
    piece of its own under the old key.
    """
    name = ["doc", "start"]
    long = pieces.filter(F.col("cuttable") & (F.length("piece") > limit))
    lines = line_rows(long.withColumnRenamed("start", "base"), ["doc", "base"], "piece").filter(F.rlike("line", F.lit(pattern)))
    lines = lines.withColumn("label", F.regexp_extract("line", pattern, 1)).withColumn("n", number)
    listed = lines.groupBy("doc", F.col("base").alias("start")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("at"), "n", "label"))).alias("lines"))
    kind = "array<struct<at:int,label:string>>"
    run = F.aggregate(
        "lines", F.array().cast(kind), lambda a, x: F.when(x["n"] == F.size(a) + 1, F.concat(a, F.array(F.struct(x["at"].alias("at"), x["label"].alias("label"))))).otherwise(a)
    )
    marks = listed.withColumn("marks", run).filter(F.size("marks") > 0).select(*name, "marks")
    head = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("label"))
    if head_joins:
        first = F.struct(F.lit(0).alias("at"), F.get("marks", 0)["label"].alias("label"))
        marks = marks.withColumn("marks", F.concat(F.array(first), F.slice("marks", 2, F.size("marks"))))
    else:
        marks = marks.withColumn("marks", F.when(F.get("marks", 0)["at"] > 0, F.concat(F.array(head), "marks")).otherwise(F.col("marks")))
    cut = pieces.join(marks, name).select("*", F.posexplode("marks").alias("i", "m"))
    end = F.coalesce(F.get("marks", F.col("i") + 1)["at"], F.length("piece"))
    named = F.col("m.label").isNotNull()
    parted = cut.select(
        "doc", F.when(named, F.concat("part", F.lit(f"-{key}-"), "m.label")).otherwise(F.col("part")).alias("part"),
        F.when(named, F.array_append("path", F.concat(F.lit(word + " "), "m.label"))).otherwise(F.col("path")).alias("path"),
        (F.col("start") + F.col("m.at")).alias("start"), (F.col("start") + end).alias("stop"), named.alias("cuttable"),
        F.substring(F.col("piece"), F.col("m.at") + 1, end - F.col("m.at")).alias("piece"),
    )
    return pieces.join(marks.select(*name), name, "left_anti").select(parted.columns).unionByName(parted)


def clauses(pieces: DataFrame, limit: int) -> DataFrame:
    return _cut(pieces, limit, CLAUSE, F.col("label").cast("int"), "khoan", "khoản", head_joins=True)


def points(pieces: DataFrame, limit: int) -> DataFrame:
    """Clauses over ``limit`` characters parted at their points a, b, c ..."""
    clause = F.col("cuttable") & F.contains("part", F.lit("-khoan-"))
    return _cut(pieces.withColumn("cuttable", clause), limit, POINT, F.ascii("label") - 96, "diem", "điểm", head_joins=False)


def _pack(text: str, limit: int) -> list[tuple[int, int]]:
    """Ranges of whole paragraphs, each closed by the first blank line beyond ``limit`` characters."""
    gaps = [(m.start(), m.end()) for m in re.finditer(r"\n\s*\n", text)]
    out, start, last = [], 0, 0
    for stop, after in gaps:
        if stop - start > limit and last > start:
            out.append((start, last))
            start = last
        last = after
    return [*out, (start, len(text))]


def packed(pieces: DataFrame, limit: int) -> DataFrame:
    """Pieces cut at blank lines into about ``limit`` characters; the second and later are ``-pt2``, ``-pt3`` ..."""

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"a": a, "b": b} for a, b in _pack(t, limit)])

    x = pieces.select("*", F.posexplode(pack("piece")).alias("i", "r"))
    return x.select(
        "doc", F.when(F.col("i") > 0, F.concat("part", F.lit("-pt"), (F.col("i") + 1).cast("string"))).otherwise(F.col("part")).alias("part"), "path",
        (F.col("start") + F.col("r.a")).alias("start"), (F.col("start") + F.col("r.b")).alias("stop"),
        F.substring(F.col("piece"), F.col("r.a") + 1, F.col("r.b") - F.col("r.a")).alias("piece"),
    )


#: Marks that are no text, bold headings, and articles that run on inside a line.
MARKUP = r"(?m)^#{1,6}[ \t]+|</?u>|\*\*|__|\*"
BOLD = r"\s*(?:Điều\s+\d|Chương\s+[IVXLC\d]|Mục\s+\d|ĐIỀU|CHƯƠNG|MỤC)"
INLINE = r"(?<=[.;:!?])[ \t]+(?=Điều\s+\d+[a-zđ]?\s*\.)"


def _rewrite(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Text with ranges replaced, and steps (place in the new text, place in the old) of its offsets."""
    out, steps, size, at = [], [(0, 0)], 0, 0
    for start, stop, new in edits:
        out += [text[at:start], new]
        size += start - at + len(new)
        at = stop
        steps.append((size, stop))
    return "".join(out) + text[at:], steps


def _plain(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Text without markup, bold headings and inline articles on lines of their own; offset steps to the original."""
    edits, inside = [], False
    for m in re.finditer(MARKUP, text):
        heading = m.group() == "**" and (inside or re.compile(BOLD).match(text, m.end()) is not None)
        inside ^= heading
        edits.append((m.start(), m.end(), "\n\n" if heading else ""))
    once, first = _rewrite(text, edits)
    twice, second = _rewrite(once, [(m.start(), m.end(), "\n\n") for m in re.finditer(INLINE, once)])
    places = [a for a, _ in first]
    old = lambda p: p - first[bisect_right(places, p) - 1][0] + first[bisect_right(places, p) - 1][1]
    back = [new + p - at for new, at in second for p in places if at < p < next((a for _, a in second if a > at), len(once) + 1)]
    steps = sorted({(new, old(at)) for new, at in second} | {(n, old(n - new + at)) for n in back for new, at in [max(s for s in second if s[0] <= n)]})
    return twice, steps


def plain(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``plain`` (text without markup) and ``steps`` (array of new, old): where its offsets lie in the text."""

    @F.pandas_udf("struct<plain:string,steps:array<struct<new:int,old:int>>>")
    def normal(texts: pd.Series) -> pd.DataFrame:
        found = [_plain(t or "") for t in texts]
        return pd.DataFrame({"plain": [t for t, _ in found], "steps": [[{"new": a, "old": b} for a, b in s] for _, s in found]})

    return docs.withColumn("_n", normal(text_col)).select("*", "_n.plain", "_n.steps").drop("_n")


def _old(steps: Column, at: Column) -> Column:
    """Offset in the original text of an offset in the plain one."""
    s = F.element_at(F.filter(steps, lambda x: x["new"] <= at), F.lit(-1))
    return at - s["new"] + s["old"]


def legal_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2000) -> DataFrame:
    """id, part, path, start, stop, body: articles, over ``limit`` cut at clauses, then points, then paragraphs.

    Offsets are of the original text, bodies without markup.
    """
    if limit < 200:
        raise ValueError("limit must be 200 at least")
    # Each step asks for the one before it several times, so each is a table.
    whole = stored(plain(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("raw")), "raw").select("doc", "plain", "steps"), "legal-plain")
    texts = whole.select("doc", F.col("plain").alias("text"))
    sections = stored(_pieces(_section_ranges(texts), texts), "legal-sections")
    pieces = packed(stored(points(stored(clauses(sections, limit), "legal-clauses"), limit), "legal-points"), limit)
    lead = F.length("piece") - F.length(F.regexp_replace("piece", rf"^{T.BLANK}+", ""))
    body = T.strip(F.col("piece"))
    placed = pieces.withColumns({"begin": F.col("start") + lead, "body": body}).filter("body <> ''").join(whole.select("doc", "steps"), "doc")
    last = F.col("begin") + F.length("body") - 1
    return placed.select(
        F.col("doc").alias(id_col), "part", "path", _old(F.col("steps"), F.col("begin")).alias("start"), (_old(F.col("steps"), last) + 1).alias("stop"), "body"
    )


def document_name(head: Column, number: Column) -> Column:
    """Title line of a legal document: below the line of its type, or below its number; empty if there is none."""
    rows = F.filter(F.transform(F.split(head, "\n"), T.strip), lambda x: x != "")
    types = [*TYPE_CODES, "BỘ LUẬT"]
    below = lambda i, k: F.get(rows, i + k)
    fit = lambda x: x.isNotNull() & (F.length(x) < 200)
    named = lambda x: fit(x) & ~F.rlike(x, F.lit(ARTICLE)) & ~F.rlike(x, F.lit(CHAPTER)) & ~F.upper(x).isin(types)
    kind = lambda x, i: F.when(fit(below(i, 1)), F.when(F.upper(x) == "LUẬT", F.concat(F.lit("Luật "), below(i, 1))).otherwise(below(i, 1)))
    by_number = lambda i: F.when(named(below(i, 1)), below(i, 1)).when(named(below(i, 2)), below(i, 2))
    found = F.transform(rows, lambda x, i: F.when(F.upper(x).isin(types), kind(x, i)).when(F.coalesce(F.contains(x, number), F.lit(False)), by_number(i)))
    return F.coalesce(F.get(F.array_compact(found), 0), F.lit(""))


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, section, level, title, path, part, start, text: Markdown cut at its headings; under two headings, none."""
    rows = _line_rows(docs, id_col, text_col).filter(F.rlike("line", F.lit(MARKDOWN)))
    own = Window.partitionBy("id").orderBy("number")
    rows = rows.withColumns(
        {
            "level": F.length(F.regexp_extract("line", MARKDOWN, 1)),
            "title": T.strip(F.regexp_extract("line", MARKDOWN, 2)),
            "section": F.row_number().over(own) - 1,
            "many": F.count(F.lit(1)).over(Window.partitionBy("id")),
            "next": F.lead("start").over(own),
        }
    ).filter("many >= 2")
    # The trail: of each higher level the last heading that no heading of its level or above follows.
    for k in range(1, 7):
        at = F.last(F.when(F.col("level") == k, F.struct("section", "title")), ignorenulls=True).over(own)
        closed = F.last(F.when(F.col("level") < k, F.col("section")), ignorenulls=True).over(own)
        rows = rows.withColumn(f"t{k}", F.when((F.col("level") >= k) & (at["section"] > F.coalesce(closed, F.lit(-1))), at["title"]))
    trail = F.array_compact(F.array(*[F.col(f"t{k}") for k in range(1, 7)]))
    key = F.substring(T.make_key(F.col("title")), 1, 60)
    out = rows.join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("whole")), "id")
    piece = T.strip(F.expr("substring(whole, start + 1, coalesce(next, length(whole)) - start)"))
    return out.select(
        F.col("id").alias(id_col), "section", "level", "title", trail.alias("path"),
        F.concat(F.lit("muc-"), F.when(key != "", key).otherwise(F.col("section").cast("string"))).alias("part"), "start", piece.alias("text"),
    )


def cite_keys(chunks: DataFrame, document: str, prefix: str, part: str, order: str) -> DataFrame:
    """Adds cite_key ``prefix#part``; the second and later of a document get ``~2``, ``~3`` ..."""
    n = F.row_number().over(Window.partitionBy(document, prefix, part).orderBy(order))
    return chunks.withColumn("cite_key", F.concat(F.col(prefix), F.lit("#"), F.col(part), F.when(n > 1, F.concat(F.lit("~"), n.cast("string"))).otherwise("")))


def own_number(head: Column) -> Column:
    """A document's own number from its first characters: after ``Số:``, else a citation that fits its type, else none."""
    head = F.regexp_replace(F.regexp_replace(head, r"(?<=\d)[ \t]+/", "/"), r"/[ \t]+(?=[A-ZĐ\d])", "/")
    bare = T.NUMBER.removeprefix("(?U)")
    line = F.regexp_extract(head, r"(?mU)^\W*(?:(?:Luật|Pháp lệnh|Nghị quyết|Bộ luật)\s+)?[Ss]ố\s*:?\s*(" + bare + ")", 1)
    label = F.regexp_extract(head, r"(?U)[Ss]ố\s*:\s*(" + bare + ")", 1)
    kind = F.upper(F.substring(head, 1, 1500))
    places = F.array(*[F.struct(F.when(F.contains(kind, F.lit(k)), F.locate(k, kind)).alias("at"), F.array(*map(F.lit, c)).alias("codes")) for k, c in TYPE_CODES.items()])
    named = F.array_min(F.filter(places, lambda x: x["at"].isNotNull()))
    fits = F.filter(T.find_numbers(head), lambda n: named.isNull() | F.exists(named["codes"], lambda c: F.contains(F.upper(n), c)))
    return F.coalesce(F.when(line != "", line), F.when(label != "", label), F.get(fits, 0))
