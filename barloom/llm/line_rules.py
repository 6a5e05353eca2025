"""Quality rules: cross-document line frequency, beside counts of one text. DataFrame functions only.

Lines are normalised (lower case, every digit 0, white space runs one space, none at the
ends) and hashed; for each host, the distinct documents that hold a line are counted.
A line is removed from every document of the host where more than ``MIN_DOCS`` documents
and more than ``SHARE`` of the host's documents hold it. A document is depleted, and
rejected, if fewer than ``MIN_WORDS`` words are left of it or less than ``LEFT`` of its own.

Hot hosts and hot lines: counts are aggregated before they are shuffled, by (host, line,
document) and then by (host, line). Joins take the keys that hold more than one part in
``PARTS`` of all rows apart: there cannot be more than ``PARTS`` of them, so those
are broadcast, and no key of the shuffled rest is larger than that part.

Words are maximal runs of characters other than space and U+0009 to U+000D. Windows of three
words are compared by the hash bits that are left beside their position, 64 less the bits of
the number of words, and then by the words themselves; only where another window's hash falls
between two equal ones could a repetition be missed (odds below 1e-6 for 20,000 words).
Within a host, a line is named by 64 bits.

Cases: null and empty texts have no words and fail the base rules; a null host counts as the
empty one; an id that is null or comes with several texts names several documents' rows, but
counts once for a line; equal rows are returned as often as they come; an empty table gives
none; other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import Stored, id_key, public_id

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WORD = "[^\\x20\\x09-\\x0D]+"

# Limits of the rules, fixed.
MIN_WORDS = 50
REPEATED = 50  # percent of the words may lie in repeated windows
MIN_DOCS = 20
SHARE = 0.01
LEFT = 0.5
PARTS = 4096


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three which the list holds twice or more."""
    n = F.size(words)
    bits = F.length(F.bin(n))

    def window_key(i: Column) -> Column:
        at = [F.get(words, i + k) for k in range(3)]
        return F.call_function("shiftleft", F.xxhash64(*at), bits).bitwiseOR(i.cast("bigint"))

    def place(key: Column) -> Column:
        return key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1).cast("int")

    def equal(a: Column, b: Column) -> Column:
        upper = [F.call_function("shiftrightunsigned", x, bits) for x in (a, b)]
        same = [F.get(words, place(a) + k) == F.get(words, place(b) + k) for k in range(3)]
        return (upper[0] == upper[1]) & same[0] & same[1] & same[2]

    def covered(keys: Column) -> Column:
        twice = F.filter(keys, lambda x, j: F.coalesce(equal(x, F.get(keys, j - 1)), F.lit(False)) | F.coalesce(equal(x, F.get(keys, j + 1)), F.lit(False)))
        places = F.sort_array(F.transform(twice, place))
        return bound(places, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(x - F.get(p, j - 1), F.lit(3)))), F.lit(0).cast("bigint"), lambda s, x: s + x))

    keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window_key))
    return F.when(n >= 3, bound(keys, covered)).otherwise(F.lit(0).cast("bigint"))


def own_counts(text: Column) -> Column:
    """The counts of one text, as an array of one struct."""
    full = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), 0)), lambda words: F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        bound(full, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words")))


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))


def rows_of(docs: DataFrame, host: str, id_col: str, text_col: str) -> DataFrame:
    """Row key (_id, _h, _host) and _text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        id_key(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), text.alias("_text"))


def lines_of(rows: DataFrame) -> DataFrame:
    """_id, _h, _host, _at, _line (hash), _words of every line with a word."""
    each = rows.select("_id", "_h", "_host", F.posexplode(F.split("_text", "\n")).alias("_at", "_raw"))
    # Exploded, so that the filter does not normalise a second time.
    plain = each.select("_id", "_h", "_host", "_at", F.explode(F.array(normalised(F.col("_raw")))).alias("_plain")).where("_plain <> ''")
    words = F.length("_plain") - F.length(F.replace("_plain", F.lit(" "), F.lit(""))) + 1
    return plain.select("_id", "_h", "_host", "_at", F.xxhash64("_plain").alias("_line"), words.alias("_words"))


def join_by_weight(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, parts: int = PARTS) -> DataFrame:
    """Inner join with unique keys on the right, where ``weight`` is the rows of the left with that key.

    The weights sum to ``total`` at most, so fewer than ``parts`` keys are heavier than total / parts.
    """
    heavy = F.broadcast(right.where(F.col(weight) * parts > total))
    light = right.where(F.col(weight) * parts <= total)
    return left.join(heavy, keys).unionByName(left.join(heavy.select(*keys), keys, "left_anti").join(light, keys))


def frequent_lines(lines: DataFrame, rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """_host, _line, _docs, _lines of the lines above both limits; ``_lines``: how often they come."""
    hosts = rows.groupBy("_host").agg(F.count_distinct("_id").alias("_host_docs"))
    by_document = lines.groupBy("_host", "_line", "_id").agg(F.count("*").alias("_times"))
    counted = by_document.groupBy("_host", "_line").agg(F.count("*").alias("_docs"), F.sum("_times").alias("_lines")).where(F.col("_docs") > min_docs)
    store = Stored(rows.sparkSession)
    counted, hosts = store.keep(counted), store.keep(hosts)
    weights = counted.groupBy("_host").agg(F.count("*").alias("_weight")).join(hosts, "_host")
    kept = join_by_weight(counted, weights, ["_host"], "_weight", counted.count())
    return kept.where(F.col("_docs") > share * F.col("_host_docs")).select("_host", "_line", "_docs", "_lines")


def line_rules(docs: DataFrame, host: str = "source", id_col: str = "doc_id", text_col: str = "text",
               min_docs: int = MIN_DOCS, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """The counts of each row of ``docs``, base_failed, removed (numbers of its lines), removed_words, kept; _id, _h, _host."""
    store = Stored(docs.sparkSession)
    rows = rows_of(docs, host, id_col, text_col)
    lines = store.keep(lines_of(rows))
    frequent = store.keep(frequent_lines(lines, rows, min_docs, share))
    hits = join_by_weight(lines, frequent, ["_host", "_line"], "_lines", lines.count())
    # One document's own lines only: a set, since equal rows bring the same lines.
    gone = hits.groupBy("_id", "_h", "_host").agg(F.sort_array(F.collect_set(F.struct("_at", "_words"))).alias("_gone"))
    counts = rows.select("_id", "_h", "_host", F.inline(own_counts(F.col("_text"))))
    both = counts.join(gone, ["_id", "_h", "_host"], "left")
    removed = F.coalesce(F.col("_gone._at"), F.array().cast("array<int>"))
    removed_words = F.coalesce(F.aggregate("_gone._words", F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(0).cast("bigint"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    rest = F.col("n_words") - F.col("removed_words")
    return (
        both.withColumn("removed", removed).withColumn("removed_words", removed_words).withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (rest >= MIN_WORDS) & (rest >= left * F.col("n_words"))).drop("_gone"))


def verdicts(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its id, counts, base_failed, removed lines and words, kept."""
    made = line_rules(docs, **options)
    return made.select(public_id().alias("doc_id"), *[c for c in made.columns if c not in ("_id", "_h", "_host")])


def clean_documents(docs: DataFrame, host: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The kept documents, all columns, without the removed lines. Equal rows stay as often as they come."""
    judged = line_rules(docs, host, id_col, text_col, **options).where("kept").select("_id", "_h", "_host", "removed").dropDuplicates(["_id", "_h", "_host"])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(id_key(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), whole)
    lines = F.split(F.col(f"_row.`{text_col}`"), "\n")
    rest = bound(lines, lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i)), "\n"))
    out = [(rest if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    return keyed.join(judged, ["_id", "_h", "_host"]).select(*out)


ORACLE = f"""
with d as (select row_number() over () rid, doc_id, coalesce(source, '') host, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^ \t-\r]+') ww, string_split(t, chr(10)) ls from d),
raw as (select rid, doc_id, host, unnest(ls) l from w),
ln as (
  select *, trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '[ \t-\r]+', ' ', 'g'), ' ') k from raw),
full_ln as (select *, len(regexp_extract_all(k, '[^ ]+')) words from ln where k <> ''),
dup as (select rid, count(*) - count(distinct l) n_dup_lines from full_ln group by rid),
pos as (select rid, ww, unnest(range(1, len(ww) - 1)) i from w),
grams as (select rid, i, count(*) over (partition by rid, ww[i] || ' ' || ww[i + 1] || ' ' || ww[i + 2]) c from pos),
spots as (select rid, unnest([i, i + 1, i + 2]) p from grams where c > 1),
rep as (select rid, count(distinct p) n_repeat_words from spots group by rid),
hosts as (select host, count(distinct coalesce(doc_id, {-(1 << 63) + 1})) n from d group by host),
freq as (
  select host, k from (select host, k, count(distinct coalesce(doc_id, {-(1 << 63) + 1})) c from full_ln group by host, k) join hosts using (host)
  where c > {MIN_DOCS} and c > {SHARE}::double * n),
gone as (select rid, sum(words)::bigint g from full_ln join freq using (host, k) group by rid),
s as (
  select doc_id, len(ww)::bigint n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g'))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(n_dup_lines, 0)::bigint n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(g, 0)::bigint removed_words
  from w left join dup using (rid) left join rep using (rid) left join gone using (rid)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEATED} * n_words base_failed, n_words - removed_words rest from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed,
  not base_failed and rest >= {MIN_WORDS} and rest >= {LEFT}::double * n_words kept
from b"""
