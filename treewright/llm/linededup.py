"""Line dedup: content-defined chunks of lines, repeated chunks removed after byte comparison.

All of it is DataFrame functions. A line ends at a newline or, as one line often
holds a whole paragraph, at a sentence's end or after WORDS words; white space after
it belongs to it, so a text's lines joined are the text. A rolling hash runs over the hashes of LINES
neighbouring lines. It chooses the chunks: of every NEAR neighbouring positions the
one with the least rolling hash (the last of equals) begins a chunk, and so do the
text's first and last position. A chunk is the LINES lines from there on (a text of
fewer lines is one chunk). So where a chunk begins depends on the lines nearby
alone, shifted copies fall into the same chunks, chunks lie at most NEAR lines apart
and cover the text, and a passage of LINES + NEAR - 1 lines or more that stands in
two texts holds a chunk of both.

Of the chunks with equal bytes the first (smallest doc_id, then position) stays. The
lines of the others go; so of a passage repeated elsewhere at most NEAR - 1 lines at
either end stay. Over 50 words are five lines or more. A line alone is no chunk, so
lone stock lines stay.

Plan: chunk hashes alone are grouped over the whole corpus; the places of
repeated hashes go back to their documents in one join on the document's key;
there the bytes of repeated chunks are compared. Hashes shared by unequal bytes
are told apart by the bytes themselves.

Defined results: no document is dropped, a document whose lines all went has an
empty text; a null text stays null, null and empty texts have no lines; rows equal
in id and text are one document and get the same result; null ids come last; other
columns pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, drop

#: Lines of a chunk and of the rolling hash.
LINES = 3
#: Neighbouring positions of which one at least begins a chunk.
NEAR = 2
#: Words of a line at most.
WORDS = 12
#: A line: up to a newline, a sentence's end or WORDS words, with the white space after it.
LINE = (
    r"[ \t\r\n]*(?:(?:[^ \t\r\n]+[ \t\r]+){0,%d}?(?:[^ \t\r\n]*[.!?][ \t\r\n]+|[^ \t\r\n]+[ \t\r]*\n[ \t\r\n]*|[^ \t\r\n]+[ \t\r]*\z)|(?:[^ \t\r\n]+[ \t\r]+){%d})|[ \t\r\n]+"
    % (WORDS - 1, WORDS)
)
#: The same for Java, whose possessive quantifiers and look-around read every word once: words that don't end a line, and one that does.
_SPACES, _WORD = r"[ \t\r\n]", r"[^ \t\r\n]"
JAVA_LINE = rf"{_SPACES}*+(?:{_WORD}++(?<![.!?])[ \t\r]++(?={_WORD})){{0,{WORDS - 1}}}+{_WORD}++{_SPACES}*+|{_SPACES}++"
#: The rolling hash: a polynomial in BASE modulo PRIME over 28-bit hashes of lines.
BASE, PRIME = 1009, 1_000_000_007


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JAVA_LINE), F.lit(0))


def _chunk_text(lines: Column, start: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, LINES), "")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row, not once a turn of the lambdas in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(rows: DataFrame) -> DataFrame:
    """rows, which have `lines`, with `starts`: the first line of each chunk."""
    rows = rows.withColumn("hashes", F.transform("lines", _line_hash))
    last = F.greatest(F.size("lines") - LINES, F.lit(0))
    at = lambda k: sum((F.coalesce(F.get("hashes", k + j), F.lit(0)) * BASE ** (LINES - 1 - j) for j in range(LINES)), F.lit(0)) % PRIME
    rows = rows.withColumn("rolled", F.transform(F.sequence(F.lit(0), last), at))

    def least(x: Column, k: Column) -> Column:
        """Whether x is the least of some NEAR neighbours, those that lie `back` before it and the others after it."""
        some = (k == 0) | (k == last)
        for back in range(NEAR):
            here = F.lit(True)
            for j in range(1, back + 1):
                here = here & (F.get("rolled", k - j) >= x)
            for j in range(1, NEAR - back):
                here = here & (F.get("rolled", k + j) > x)
            some = some | F.coalesce(here, F.lit(False))
        return some

    places = F.transform("rolled", lambda x, k: F.when(least(x, k), k))
    return rows.withColumn("starts", F.when(F.size("lines") > 0, F.filter(places, lambda k: k.isNotNull())))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with text_col without repeated chunks, and n_lines and n_removed, in that order after docs' columns.

    chunk_hash hashes a chunk's text; without it, its lines are hashed as they are, which spares joining them.
    n_lines and n_removed replace columns of docs that have these names.
    """
    key = [F.col(f"doc.`{id_col}`").alias("id"), F.xxhash64(F.col(f"doc.`{text_col}`")).alias("sum")]
    text = F.col(f"doc.`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    # Hashes are built before explode, or each exploded row would carry all lines.
    chunks = _starts(rows.select(*key, _lines(text).alias("lines")))
    hash_of = lambda lines, k: chunk_hash(_chunk_text(lines, k)) if chunk_hash else F.xxhash64(*[F.get(lines, k + j) for j in range(LINES)])
    hashed = lambda x: F.transform(x["starts"], lambda k: F.struct(k.alias("idx"), hash_of(x["lines"], k).alias("hash")))
    chunks = chunks.select("id", "sum", _with(F.struct("starts", "lines"), hashed).alias("chunks"))
    # inline_outer: the filters that Spark infers for inline repeat the whole expression many times.
    places = cut(chunks.select("id", "sum", F.inline_outer("chunks")).where("hash is not null"), "lines-places", "zstd")
    # Written, so that both sides of the joins have an exchange of their own and a frequent chunk's rows can be split.
    repeated = cut(places.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "lines-repeated")
    found = cut(places.join(repeated, "hash"), "lines-found", "zstd")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "sum", "idx")
    firsts = cut(found.groupBy("hash").agg(F.min(order).alias("first")), "lines-firsts")
    drop(places)
    drop(repeated)
    written = found, firsts
    found = found.join(firsts, "hash").select("id", "sum", F.struct("idx", "hash", (order == F.col("first")).alias("first")).alias("place"))
    found = found.groupBy("id", "sum").agg(F.collect_set("place").alias("places"))
    joined = rows.select("doc", *key).alias("a").join(found.alias("b"), F.expr("a.id <=> b.id and a.sum = b.sum"), "left").select("doc", "a.id", "a.sum", "places")
    joined = cut(joined, "lines-joined", "zstd")
    for old in written:
        drop(old)

    texts = lambda lines: F.transform("places", lambda p: F.struct(p["idx"].alias("idx"), p["hash"].alias("hash"), _chunk_text(lines, p["idx"]).alias("t")))
    held = joined.where("places is not null").select("id", "sum", F.inline_outer(_with(_lines(text), texts))).where("hash is not null")
    unequal = cut(held.select("hash", "t").distinct().groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "lines-unequal")
    kept = F.array().cast("array<int>")
    if not unequal.isEmpty():
        own = held.join(unequal, "hash", "left_semi").groupBy("hash", "t").agg(F.min(order).alias("first"))
        own = own.select("first.id", "first.sum", "first.idx").groupBy("id", "sum").agg(F.collect_set("idx").alias("own"))
        marked = F.transform("places", lambda p: p["hash"])
        told = joined.where("places is not null").select("id", "sum", F.explode(marked).alias("hash")).distinct().join(unequal, "hash", "left_semi")
        told = told.groupBy("id", "sum").agg(F.collect_set("hash").alias("told"))
        joined = joined.alias("a").join(told.alias("b"), F.expr("a.id <=> b.id and a.sum = b.sum"), "left").select("a.*", "told")
        joined = joined.alias("a").join(own.alias("b"), F.expr("a.id <=> b.id and a.sum = b.sum"), "left").select("a.*", "own")
        gone = F.filter("places", lambda p: F.when(F.array_contains(F.coalesce("told", F.array().cast("array<bigint>")), p["hash"]), ~F.array_contains(F.coalesce("own", kept), p["idx"])).otherwise(~p["first"]))
    else:
        gone = F.filter("places", lambda p: ~p["first"])
    out = joined.withColumn("lines", _lines(text)).withColumn("n_all", F.greatest(F.size("lines"), F.lit(0)))
    numbers = F.flatten(F.transform(gone, lambda p: F.sequence(p["idx"], F.least(p["idx"] + LINES, F.col("n_all")) - 1)))
    out = out.withColumn("gone", F.array_distinct(numbers))
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_all") - 1), F.col("gone"))
    rest = _with(F.col("lines"), lambda lines: F.array_join(F.transform(stay, lambda k: F.get(lines, k)), ""))
    new = F.when(F.size("gone") > 0, rest).otherwise(text)
    columns = [new.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return out.select(*columns, F.col("n_all").cast("long").alias("n_lines"), F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


#: The same rule in DuckDB SQL, with doc_id and text of documents, for LINES = 3; ids must be unique.
_LEAST = " or ".join(
    "coalesce(" + " and ".join([*[f"lag(r, {j}) over w >= r" for j in range(1, back + 1)], *[f"lead(r, {j}) over w > r" for j in range(1, NEAR - back)]]) + ", false)" for back in range(NEAR)
)
DEDUP_SQL = f"""
lines as (
  select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as i, len(ls) as n, greatest(len(ls) - {LINES}, 0) as last
  from (select doc_id, regexp_extract_all(text, '{LINE.replace("{", "{{").replace("}", "}}")}') as ls from {{docs}} where text is not null)
), hashed as (
  select *, ('0x' || substr(md5(line), 1, 7))::bigint as h from lines
), rolled as (
  select *, case when i <= last then (h * {BASE**2} + coalesce(lead(h) over w, 0) * {BASE} + coalesce(lead(h, 2) over w, 0)) % {PRIME} end as r,
         line || coalesce(lead(line) over w, '') || coalesce(lead(line, 2) over w, '') as t
  from hashed window w as (partition by doc_id order by i)
), chosen as (
  select *, i <= last and (i = 0 or i = last or {_LEAST}) as begins from rolled window w as (partition by doc_id order by i)
), firsts as (
  select t, min(struct_pack(d := doc_id, k := i)) as f from chosen where begins group by t having count(*) > 1
), again as (
  select doc_id, i from chosen c join firsts f on c.t = f.t where begins and struct_pack(d := doc_id, k := i) <> f.f
), gone as (
  select distinct doc_id, unnest(range(i, i + {LINES})) as i from again
), deduped as (
  select l.doc_id, coalesce(string_agg(line, '' order by l.i) filter (g.i is null), '') as text, count(*) as n_lines, count(g.i) as n_removed
  from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id
)"""

ORACLE = f"""with {DEDUP_SQL.format(docs="documents")}
select d.doc_id, case when d.text is not null then coalesce(x.text, '') end as text, coalesce(x.n_lines, 0)::bigint as n_lines, coalesce(x.n_removed, 0)::bigint as n_removed
from documents d left join deduped x using (doc_id)"""
