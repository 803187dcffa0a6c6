"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

Words with a digit are variable fields at once (<*>). The tree's levels are a line's number of words
and its first DEPTH words; lines that end in the same leaf share a template: at each position
the word that more than half of the leaf's distinct lines have, or a variable field. A line belongs to
its leaf's template if SIMILAR or more of its words are the template's; otherwise it is a template of
its own.

A template that is in MANY or more different texts is boilerplate: its lines are dropped from all of
them. One in 2 to MANY - 1 texts is dropped from all but one of them (that with the smallest MD5) if
FIXED or more of its words are not variable; shorter lines meet by chance, and stay. Copies of a text count
once and are treated alike, so a document isn't emptied for having been copied.

Each line is split, masked and hashed once and travels as numbers from then on: text, position, line and
leaf. Words are spelled out only for leaves that have several lines in several texts, and are fetched
from the texts for one place of each line. Groupings have partial sums, so a line that is in a third of all
texts is one row a task; what is joined lies stored, so that a hot key's rows are split by Spark.

Null and empty text: no line dropped, kept as it is. Lines without a word are never dropped.
Repeated rows, whatever their ids, get equal results. Empty table: empty result. Columns of docs that
are named like the results' own get _in appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, put_back, set_aside, spool, table

DEPTH, SIMILAR, MANY, FIXED = 3, 0.5, 10, 8
BLANK = r"\x20\x09-\x0D"
TEXT, LINE, LEAF, TEMPLATE = ["t1", "t2"], ["l1", "l2"], ["f1", "f2"], ["m1", "m2"]


def _text_key() -> list[Column]:
    """Two halves of the first 30 hex digits of a text's MD5."""
    digest = F.md5(F.col("text").cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(n) for at, n in ((1, "t1"), (16, "t2"))]


def _digest(names: list[str], *cols) -> dict[str, Column]:
    """128 bits, never null: two 64-bit hashes with different seeds."""
    return {n: F.xxhash64(F.lit(n), *cols) for n in names}


def _masked(raw: Column) -> Column:
    """The line with its variable fields and single blanks."""
    masked = F.regexp_replace(raw, rf"(?<![^{BLANK}])[^{BLANK}0-9]*+[0-9][^{BLANK}]*", "<*>")
    masked = F.when(raw.rlike("[0-9]"), masked).otherwise(raw)
    uneven = raw.rlike(rf"[{BLANK}]{{2}}|[\x09-\x0D]")
    return F.trim(F.when(uneven, F.regexp_replace(masked, rf"[{BLANK}]+", " ")).otherwise(masked))


def _count(text: Column, part: str) -> Column:
    """How often part is in text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def lines_of(docs: DataFrame) -> DataFrame:
    """t1, t2, pos, l1, l2, f1, f2, n, fixed (words that are not variable) of lines that have a word."""
    # Digest and split come below the generator, or the whole text would be hashed once a line; the
    # outer form as split is never empty, and the plain one would split a second time to test that.
    parts = docs.filter("text IS NOT NULL").select(*_text_key(), F.split("text", "\n").alias("parts"))
    raw = parts.select(*TEXT, F.posexplode_outer("parts").alias("pos", "raw")).filter(F.col("raw").rlike(rf"[^{BLANK}]"))
    x = raw.select(*TEXT, "pos", _masked(F.col("raw")).alias("line"))
    x = x.withColumn("n", _count(F.col("line"), " ") + 1)
    fixed = F.col("n") - _count(F.concat(F.lit(" "), F.replace("line", F.lit(" "), F.lit("  ")), F.lit(" ")), " <*> ")
    return x.select(*TEXT, "pos", *[c.alias(n) for n, c in (_digest(LINE, "line") | _digest(LEAF, "n", F.substring_index("line", " ", DEPTH))).items()], "n", fixed.alias("fixed"))


def _spelled(docs: DataFrame, places: DataFrame) -> DataFrame:
    """f1, f2, l1, l2, line of the lines at places (t1, t2, pos)."""
    asked = spool(places.groupBy(*TEXT).agg(F.collect_list("pos").alias("asked")), "asked")
    found = docs.filter("text IS NOT NULL").select(*_text_key(), "text").join(asked.hint("merge"), TEXT)
    parts = found.select(F.split("text", "\n").alias("parts"), "asked")
    raw = parts.select(F.explode(F.transform("asked", lambda k: F.col("parts")[k])).alias("raw"))
    x = raw.select(_masked(F.col("raw")).alias("line")).distinct()
    return x.select("line", *[c.alias(n) for n, c in (_digest(LINE, "line") | _digest(LEAF, _count(F.col("line"), " ") + 1, F.substring_index("line", " ", DEPTH))).items()])


def templates(lines: DataFrame) -> DataFrame:
    """l1, l2, m1, m2, fixed: the template of each distinct line (f1, f2, l1, l2, line) and its words that are not variable. What is joined by leaf is stored, so that a hot leaf can be split."""
    words = lines.select(*LEAF, *LINE, F.posexplode(F.split("line", " ")).alias("pos", "word"))
    sizes = spool(lines.groupBy(*LEAF).agg(F.count("*").alias("size")), "sizes")
    uses = spool(words.groupBy(*LEAF, "pos", "word").agg(F.count("*").alias("c")), "words")
    most = spool(uses.join(sizes, LEAF).filter("2 * c > size").select(*LEAF, "pos", "word"), "fixed")
    alike = words.join(most, [*LEAF, "pos", "word"]).groupBy(*LINE).agg(F.count("*").alias("same"))
    own = lines.select(*LEAF, *LINE, F.size(F.split("line", " ")).alias("n"), F.size(F.filter(F.split("line", " "), lambda w: w != "<*>")).alias("own"))
    shared = spool(most.groupBy(*LEAF).agg(F.count_if(F.col("word") != "<*>").cast("int").alias("shared")), "shared")
    x = own.join(alike, LINE, "left").join(shared, LEAF, "left")
    is_leaf = F.coalesce("same", F.lit(0)) >= SIMILAR * F.col("n")
    return x.select(*LINE, *[F.when(is_leaf, F.col(f)).otherwise(F.col(k)).alias(m) for f, k, m in zip(LEAF, LINE, TEMPLATE, strict=True)], F.when(is_leaf, F.coalesce("shared", F.lit(0))).otherwise(F.col("own")).alias("fixed"))


def dropped(docs: DataFrame, many: int = MANY, fixed: int = FIXED) -> DataFrame:
    """t1, t2, gone: the places of lines that are dropped from each text that loses any."""
    lines = spool(lines_of(docs), "lines")
    ends = [f(c).alias(f"{n}_{c}") for c in ("t1", "l1") for n, f in (("a", F.min), ("z", F.max))]
    leaves = lines.groupBy(*LEAF, "n").agg(F.count("*").alias("uses"), *ends)
    # no template has more words than its lines, nor more texts than lines
    leaves = leaves.filter(f"a_t1 <> z_t1 AND (n >= {fixed} OR uses >= {many})")
    leaves = spool(leaves.select(*LEAF, (F.col("a_l1") != F.col("z_l1")).alias("several")), "leaves")
    found = spool(lines.join(leaves, LEAF), "found")
    places = found.filter("several").groupBy(*LINE).agg(F.min(F.struct(*TEXT, "pos")).alias("at")).select("at.*")
    named = spool(templates(spool(_spelled(docs, places), "spelled")), "templates")
    alone = found.filter("NOT several").select(*TEXT, "pos", *[F.col(f).alias(m) for f, m in zip(LEAF, TEMPLATE, strict=True)], "fixed")
    uses = spool(found.filter("several").select(*TEXT, "pos", *LINE).join(named, LINE).select(*TEXT, "pos", *TEMPLATE, "fixed").unionByName(alone), "uses")
    often = uses.groupBy(*TEMPLATE, *TEXT).agg(F.max("fixed").alias("fixed")).groupBy(*TEMPLATE).agg(F.count("*").alias("texts"), F.min("t1").alias("first"), F.max("fixed").alias("most"))
    often = often.filter(f"texts >= {many} OR (texts >= 2 AND most >= {fixed})").select(*TEMPLATE, F.when(F.col("texts") < many, F.col("first")).alias("stays"))
    gone = uses.select(*TEXT, "pos", *TEMPLATE).join(spool(often, "often"), TEMPLATE).filter("stays IS NULL OR stays <> t1")
    out = spool(gone.groupBy(*TEXT).agg(F.collect_set("pos").alias("gone")), "gone")
    discard(lines, leaves, found, named, uses)
    return out


def drop_recurring(docs: DataFrame, many: int = MANY, fixed: int = FIXED) -> DataFrame:
    """docs with kept_text, n_lines, n_dropped."""
    docs, own = set_aside(docs)
    out = docs.withColumns({f"_{c}": v for c, v in zip(TEXT, _text_key(), strict=True)})
    at = dropped(docs, many, fixed).withColumnsRenamed({c: f"_{c}" for c in TEXT})
    out = out.join(at.hint("merge"), [f"_{c}" for c in TEXT], "left").withColumn("_parts", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.col("_parts")[i]), "\n")
    out = out.select(
        *docs.columns,
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        F.coalesce(F.size("_parts"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return put_back(out, own)


def op3_line_templates(spark, sf_dir: str) -> DataFrame:
    out = drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("kept_text").cast("long").alias("kept_chars"), F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


TEMPLATES_SQL = rf"""
WITH raw AS (
  SELECT DISTINCT md5(text) AS text_key, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT text_key, pos, trim(regexp_replace(regexp_replace(raw, '[^{BLANK}]*[0-9][^{BLANK}]*', '<*>', 'g'), '[{BLANK}]+', ' ', 'g'), ' ') AS line FROM raw),
keyed AS (
  SELECT *, len(string_split(line, ' ')) AS n, array_to_string(list_slice(string_split(line, ' '), 1, {DEPTH}), ' ') AS head FROM lines WHERE line <> ''),
leaves AS (SELECT n, head FROM keyed GROUP BY n, head HAVING count(DISTINCT text_key) >= 2),
dist AS (SELECT DISTINCT k.n, k.head, k.line FROM keyed k JOIN leaves l ON k.n = l.n AND k.head = l.head),
words AS (SELECT n, head, line, unnest(range(n)) AS at, unnest(string_split(line, ' ')) AS word FROM dist),
sizes AS (SELECT n, head, count(*) AS size FROM dist GROUP BY n, head),
fixed AS (
  SELECT w.n, w.head, w.at, w.word FROM words w JOIN sizes s ON w.n = s.n AND w.head = s.head
  GROUP BY w.n, w.head, w.at, w.word, s.size HAVING 2 * count(*) > s.size),
alike AS (
  SELECT w.line, count(*) AS same FROM words w JOIN fixed f ON w.n = f.n AND w.head = f.head AND w.at = f.at AND w.word = f.word GROUP BY w.line),
shared AS (SELECT n, head, count(*) FILTER (word <> '<*>') AS shared FROM fixed GROUP BY n, head),
named AS (
  SELECT d.line, coalesce(a.same, 0) >= {SIMILAR} * d.n AS is_leaf, CASE WHEN is_leaf THEN 'leaf ' || d.n || ' ' || d.head ELSE 'line ' || d.line END AS template,
    CASE WHEN is_leaf THEN coalesce(s.shared, 0) ELSE len(list_filter(string_split(d.line, ' '), lambda w: w <> '<*>')) END AS fixed
  FROM dist d LEFT JOIN alike a ON d.line = a.line LEFT JOIN shared s ON d.n = s.n AND d.head = s.head),
uses AS (SELECT k.text_key, k.pos, m.template, m.fixed FROM keyed k JOIN named m ON k.line = m.line),
often AS (
  SELECT template, CASE WHEN count(DISTINCT text_key) < {MANY} THEN min(text_key) END AS stays FROM uses GROUP BY template
  HAVING count(DISTINCT text_key) >= {MANY} OR (count(DISTINCT text_key) >= 2 AND max(fixed) >= {FIXED})),
gone AS (
  SELECT u.text_key, u.pos FROM uses u JOIN often o ON u.template = o.template WHERE o.stays IS NULL OR o.stays <> u.text_key),
gone_at AS (SELECT text_key, list(DISTINCT pos) AS gone_pos FROM gone GROUP BY text_key),
res AS (
  SELECT d.doc_id, d.text, a.gone_pos, string_split(d.text, chr(10)) AS parts FROM documents d LEFT JOIN gone_at a ON md5(d.text) = a.text_key),
done AS (
  SELECT doc_id, coalesce(len(parts), 0) AS n_lines, coalesce(len(gone_pos), 0) AS n_dropped,
    CASE WHEN gone_pos IS NULL THEN text ELSE coalesce(array_to_string([parts[i + 1] FOR i IN range(len(parts)) IF NOT list_contains(gone_pos, i)], chr(10)), '') END AS kept FROM res)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, CAST(length(kept) AS BIGINT) AS kept_chars, md5(kept) AS kept_md5 FROM done
"""

QUERIES = {"op3_line_templates": op3_line_templates}
ORACLES = {"op3_line_templates": TEMPLATES_SQL}
