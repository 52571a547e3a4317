"""Line dedup: an exact set-similarity join of lines, in DataFrame functions alone.

A line is its set of words (parted by ASCII white space, lower-cased), and counts if it has any. It goes if an earlier line,
by (doc_id, number), has a set with a Jaccard similarity of 0.8 or more; whether that line itself stays doesn't matter.

Lines of equal words in equal order count once, under 128 bits of hash, for which their first line stands. A word is a long: its rarity,
then its hash, so sorting a line's words orders them by rarity (a count sketch of fixed size, 128 kB, that each task gets with its
code). Two lines as similar as that share one of their n - ceil(0.8 n) + 1 first words. Each such word has a list of lines, in order of size:

1. A line is in three families: by the three of its rarer words with the smallest hashes, by the three with the largest, and by three of its other words. An
   edit of a long line seldom touches them all, so near copies share a family. A line is held against some of its family before it: the first, and those
   LAGS places before. That settles nearly all members of a group of near copies, with three rows a line and a fixed number of candidates.
2. Lines meet in their lists, the larger looking for the smaller. A line can be found only at places where a line of its size or larger could still
   match it, so about half of its rows are looked for. Pairs pass the length filter (in long lists, size classes are part of the join key), the positional filter
   and a bound on the difference by parity bits, all conditions of the join: pairs that fail them are never rows. Pairs whose later line is settled are left out,
   so that a group of near copies is not tried in pairs once more.

Candidates of either step are verified on the words themselves. Lists of frequent words are split by salts. Joins whose smaller side follows the input are
sort-merge joins at every size, so that what a small input shuffles tells what a large one will.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._work import Workspace

SIMILAR = 80
#: Count sketch: 2 ** SKETCH_BITS levels, each twice the binary logarithm of a count.
SKETCH_BITS = 17
HASH_BITS = 56
#: Lines of so many words have parity bits of 128 places, shorter ones of 64.
LONG = 96
#: Longs of parity bits that candidates are held against before their words (a power of 2).
WIDE = 4
#: Lines of so many words have them.
WIDE_AT = 224
#: Lists of words that occur more than 2 ** SALT_AT times are split.
SALT_AT = 17
#: Lists go in so many passes (a power of 2), by hash of the word, so that only a share of them is shuffled at once.
PASSES = 4
#: A family goes by so many words, drawn by so many bits of their hashes.
FAMILY = 3
DRAW_BITS = 40
#: Step 1 holds a line against the first of its family and those so many places before it.
LAGS = (1, 2)
#: Lists of words that occur more than 2 ** CLASS_AT times are searched by size class.
CLASS_AT = 8
LINE = ("doc_id", "row", "no")


def plain(text: Column) -> Column:
    """Lower-cased text whose lines have words parted by single spaces."""
    odd = text.contains("  ")
    for space in "\t\x0b\f\r":
        odd = odd | text.contains(space)
    return F.lower(F.when(odd, F.regexp_replace(text, "[ \t\x0b\f\r]+", " ")).otherwise(text))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, no, line) of all lines with words; docs: (doc_id, row, text)."""
    rows = docs.select("doc_id", "row", F.posexplode(F.split(plain(F.col("text")), "\n", -1)).alias("no", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''")


def words(line: Column) -> Column:
    return F.split(line, " ")


def _bucket(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 64 - SKETCH_BITS).cast("int")


def rarity(lines: DataFrame) -> list[int]:
    """A level for each bucket of words: twice the binary logarithm of how often they occur. Its size doesn't depend on the data."""
    counts = lines.select(F.explode(words(F.col("line"))).alias("w")).groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count("*").alias("k"))
    levels = [0] * (1 << SKETCH_BITS)
    for r in counts.select("b", F.floor(2 * F.log2(F.col("k") + 1)).cast("int").alias("q")).toLocalIterator():
        levels[r.b] = r.q
    return levels


def signature() -> tuple[Column, Column]:
    """128 bits that stand for a line."""
    return F.xxhash64("line").alias("sig"), F.xxhash64(F.lit(7), "line").alias("sig2")


def need(n: Column) -> Column:
    return F.floor((n * SIMILAR + 99) / 100).cast("int")


def prefixes(lines: DataFrame, levels: list[int]) -> DataFrame:
    """Of each line: size, parity bits, families and first words by rarity, in place of its text.

    No array here may hold null by its type, as Spark would sort objects then and not numbers.
    """
    level = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")

    def token(h: Column) -> Column:
        return F.shiftleft(F.coalesce(F.get(level, _bucket(h)), F.lit(0).cast("long")), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    others = [c for c in lines.columns if c != "line"]
    hashes = F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w)))
    sets = lines.select(*others, *signature(), F.sort_array(F.transform(hashes, token)).alias("toks"))
    sets = sets.withColumn("n", F.size("toks")).withColumn("first", F.col("n") - need(F.col("n")) + 1)
    half = F.when(F.col("n") >= LONG, _parity(F.col("toks"), lambda x: x.bitwiseAND(F.lit(64)) != 0)).otherwise(0)
    cut = F.greatest(F.col("first"), F.shiftright(F.col("n"), 1))
    sets = sets.withColumns({"rarer": _drawn(F.slice("toks", 1, cut)), "others": _drawn(F.slice("toks", cut + 1, F.col("n")))})
    few, ends = F.array(_family(F.slice("rarer", 1, FAMILY))), [F.slice("rarer", 1, FAMILY), F.slice("rarer", -FAMILY, FAMILY), F.slice("others", 1, FAMILY)]
    ends = F.when((F.size("rarer") < 2 * FAMILY) | (F.size("others") < FAMILY), few).otherwise(F.array(*map(_family, ends)))
    return sets.select(*others, "sig", "sig2", "n", _parity(F.col("toks")).alias("bits"), half.alias("half"), ends.alias("family"), F.slice("toks", 1, F.col("first")).alias("toks"))


def _drawn(toks: Column) -> Column:
    """Words in order of low bits of their hashes, levels last. Words of a level stand in order of the high bits, so that edits would push out words at the end of these."""
    return F.sort_array(F.transform(toks, lambda x: F.shiftleft(x, 64 - DRAW_BITS).bitwiseOR(F.shiftrightunsigned(x, HASH_BITS))))


def _family(some: Column) -> Column:
    """A family's key; it has no more lines than the rarest of its words, so it is split by that one's salts."""
    rare = F.least(*(F.get(some, F.lit(i)).bitwiseAND(F.lit((1 << 64 - HASH_BITS) - 1)) for i in range(FAMILY)))
    return F.xxhash64(some, F.pmod(F.col("sig"), _salts(F.shiftleft(rare, HASH_BITS))))


def _parity(toks: Column, of=None) -> Column:
    """64 bits: how many of the words (for which a condition holds) have each remainder, modulo 2."""
    flip = lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))
    return F.aggregate(toks, F.lit(0).cast("long"), flip if of is None else lambda a, x: F.when(of(x), flip(a, x)).otherwise(a))


def _alike(n: Column, bits: Column, half: Column, m: Column, bits2: Column, half2: Column) -> Column:
    """Length and parity filters of two lines.

    Long lines have their words in two halves, so theirs are 128 bits.
    """
    all_, some = bits.bitwiseXOR(bits2), half.bitwiseXOR(half2)
    apart = F.when((n >= LONG) & (m >= LONG), F.bit_count(some) + F.bit_count(all_.bitwiseXOR(some))).otherwise(F.bit_count(all_))
    return (100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)) & ((100 + SIMILAR) * apart <= (100 - SIMILAR) * (n + m))


def _level(tok: Column) -> Column:
    """Binary logarithm of the number of times that a word may occur."""
    return F.floor(F.shiftrightunsigned(tok, HASH_BITS) / 2).cast("int")


def _salts(tok: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), _level(tok) - SALT_AT))


def wide_parity(w: Column) -> Column:
    """WIDE longs of parity bits of distinct words: two lines differ in as many words at least as in bits."""
    def bits(i: int) -> Column:
        one = lambda h: F.when(F.shiftright(h, 6).bitwiseAND(F.lit(WIDE - 1)) == i, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)))).otherwise(0)
        return F.aggregate(F.transform(w, lambda x: F.hash(x)), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(one(h)))

    return F.array(*(bits(i) for i in range(WIDE)))


def _words_agree(ws: Workspace, name: str, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Ids (late) of pairs (late, early, sum) whose words are similar."""
    for side in ("late", "early"):
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("w").alias(f"{side}_w")).hint("merge"), side)
    same = (100 + SIMILAR) * F.size(F.array_intersect("late_w", "early_w")) >= SIMILAR * F.col("sum")
    return ws.table(name, pairs.where(same).select("late").distinct())


def verified(ws: Workspace, name: str, pairs: DataFrame, heads: DataFrame, lines: DataFrame) -> DataFrame:
    """Ids of lines that are similar to an earlier one of their pairs (one, other), by the words themselves; of very long lines, wide parity bits go first.

    A line is held against one of its earlier lines first, and against the others if that one is not similar.
    """
    pairs = ws.table(f"{name}-pairs", pairs.distinct())
    asked = ws.table(f"{name}-asked", pairs.select(F.explode(F.array("one", "other")).alias("id")).distinct().join(heads.select("id", *LINE).hint("merge"), "id"))
    ws.drop()
    texts = lines.join(asked.hint("merge"), list(LINE)).select("id", F.struct("doc_id", "no").alias("place"), "line").dropDuplicates(["id"])
    texts = texts.withColumn("w", F.array_distinct(words(F.col("line")))).withColumn("n", F.size("w"))
    texts = ws.table(f"{name}-texts", texts.select("id", "place", "n", F.when(F.col("n") >= WIDE_AT, wide_parity(F.col("w"))).alias("bits"), "w"))
    ws.drop()
    both = pairs
    for side in ("one", "other"):
        both = both.join(texts.select(F.col("id").alias(side), F.struct("place", "id", "n", "bits").alias(f"{side}_")).hint("merge"), side)
    both = both.select(F.greatest("one_", "other_").alias("late"), F.least("one_", "other_").alias("early")).where("late.place > early.place")
    apart = sum((F.bit_count(F.get("late.bits", F.lit(i)).bitwiseXOR(F.get("early.bits", F.lit(i)))) for i in range(WIDE)), F.lit(0))
    total = F.col("late.n") + F.col("early.n")
    both = both.where(F.coalesce((100 + SIMILAR) * apart <= (100 - SIMILAR) * total, F.lit(True)))
    likely = ws.table(f"{name}-likely", both.select(F.col("late.id").alias("late"), F.col("early.id").alias("early"), total.alias("sum")))
    one = likely.groupBy("late").agg(F.min("early").alias("early")).join(likely.hint("merge"), ["late", "early"])
    hits = _words_agree(ws, f"{name}-hits", one, texts)
    more = _words_agree(ws, f"{name}-more", likely.join(hits.hint("merge"), "late", "left_anti"), texts)
    ws.drop(f"{name}-pairs", f"{name}-asked", f"{name}-texts", f"{name}-likely")
    return hits.union(more).select(F.col("late").alias("id"))


def families(reps: DataFrame) -> DataFrame:
    """Pairs (one, other) of lines that have some of a family before them, with a few of these."""
    own = Window.partitionBy("key").orderBy("doc_id", "no", "id")
    one = F.struct("id", "n", "bits", "half")
    rows = reps.select(F.explode("family").alias("key"), "doc_id", "no", "id", "n", "bits", "half")
    rows = rows.withColumns({"p0": F.first(one).over(own)} | {f"p{i}": F.lag(one, i).over(own) for i in LAGS}).where(F.col(f"p{LAGS[0]}").isNotNull())
    prev = [F.when(_alike(F.col("n"), F.col("bits"), F.col("half"), F.col(f"{p}.n"), F.col(f"{p}.bits"), F.col(f"{p}.half")), F.col(f"{p}.id")) for p in ("p0", *(f"p{i}" for i in LAGS))]
    return rows.select(F.col("id").alias("one"), F.explode(F.array_distinct(F.array_compact(F.array(*prev)))).alias("other")).where("one <> other")


def met(sets: DataFrame, k: int) -> DataFrame:
    """Pairs (one, other) of lines that meet in a list of pass k and pass the filters; the first is as large as the other or larger.

    A line has its home in one part of a list, if a line of its size or larger can match it at this place, and looks for
    smaller ones in all salts and, in long lists, in its own size class and the one below. Where sets tell the document (doc),
    a settled line meets only lines of its own and later ones, as it is looked for as their earlier line alone.
    """
    told = "doc" in sets.columns
    own = ("id", *(["doc"] if told else []))
    rows = sets.select(*own, "n", "bits", "half", "settled", F.posexplode("toks").alias("at", "tok"))
    rows = rows.where(F.shiftrightunsigned("tok", 20).bitwiseAND(F.lit(PASSES - 1)) == k)
    tok, long = F.col("tok"), _level(F.col("tok")) >= CLASS_AT
    # sizes of two similar lines lie in the same class or in classes side by side
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / SIMILAR) + 1e-9).cast("int")
    # the largest size that can match at this place
    rows = rows.withColumn("reach", (F.floor((100 + SIMILAR) * (F.col("n") - F.col("at")) / SIMILAR + 1e-9) - F.col("n")).cast("int"))
    salts = _salts(tok)
    part = lambda c, s: F.xxhash64("tok", c, s)
    both = lambda s: F.array(part(size_class, s), part(size_class - 1, s))
    every = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), salts - 1), both))
    sizes = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft("reach", 1).cast("long")).bitwiseOR(F.col("settled").cast("long")).alias("sizes")
    home = rows.where("reach >= n").select(F.when(long, part(size_class, F.pmod(F.xxhash64("id"), salts))).otherwise(tok).alias("key"), *own, sizes, "bits", "half")
    keys = F.when(~long, F.array(tok)).when(salts == 1, both(F.lit(0).cast("long"))).otherwise(every)
    seek = rows.select(F.explode(keys).alias("key"), *own, sizes, "bits", "half")
    a, b = seek.alias("a"), home.alias("b")
    n, m = (F.shiftright(f"{s}.sizes", 32) for s in "ab")
    reach, reach2 = (F.shiftright(F.col(f"{s}.sizes").bitwiseAND(F.lit((1 << 32) - 1)), 1) for s in "ab")
    all_, some = (F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in ("bits", "half"))
    near = lambda apart: (100 + SIMILAR) * apart <= (100 - SIMILAR) * (n + m)
    fits = near(F.bit_count(all_)) & (100 * m >= SIMILAR * n) & (n <= reach2) & (m <= reach) & ((n > m) | ((n == m) & (F.col("a.id") > F.col("b.id"))))
    fits = fits & ((m < LONG) | near(F.bit_count(some) + F.bit_count(all_.bitwiseXOR(some)))) & (F.col("a.sizes").bitwiseAND(F.col("b.sizes")).bitwiseAND(F.lit(1)) == 0)
    if told:
        late = lambda s, t: (F.col(f"{s}.sizes").bitwiseAND(F.lit(1)) == 0) | (F.col(f"{s}.doc") <= F.col(f"{t}.doc"))
        fits = fits & late("a", "b") & late("b", "a")
    return a.join(b.hint("shuffle_hash"), (F.col("a.key") == F.col("b.key")) & fits).select(F.col("a.id").alias("one"), F.col("b.id").alias("other"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, nos): numbers of the lines to remove from each row of docs (doc_id, row, text)."""
    ws = Workspace(docs.sparkSession, "lines")
    lines = ws.table("lines", lines_of(docs))
    firsts = lines.groupBy(*signature()).agg(F.min(F.struct("doc_id", "no", "row", "line")).alias("r"), F.count("*").alias("times")).select("times", "r.*")
    reps = ws.table("reps", prefixes(firsts.withColumn("id", F.monotonically_increasing_id()), rarity(lines)))
    ws.drop()
    heads = ws.table("heads", reps.select("sig", "sig2", "times", "id", *LINE))
    near = verified(ws, "near", families(reps), heads, lines)
    sets = reps.join(near.withColumn("settled", F.lit(1)).hint("merge"), "id", "left").select("id", F.col("doc_id").alias("doc"), "n", "bits", "half", F.coalesce("settled", F.lit(0)).alias("settled"), "toks")
    sets = ws.table("sets", sets)
    ws.drop("reps")
    far = []
    for k in range(PASSES):
        far.append(ws.table(f"far{k}", met(sets, k)))
        ws.drop()
    ws.drop("sets")  # not to lie beside the texts
    far = verified(ws, "far", functools.reduce(DataFrame.unionAll, far), heads, lines)
    hits = near.union(far).distinct().withColumn("hit", F.lit(True))
    state = heads.join(hits.hint("merge"), "id", "left").where("hit or times > 1").select("sig", "sig2", "hit", F.struct("doc_id", "no").alias("first"))
    gone = lines.select(*LINE, *signature()).join(state.hint("merge"), ["sig", "sig2"]).where("hit or struct(doc_id, no) > first")
    out = ws.table("gone", gone.groupBy("doc_id", "row").agg(F.collect_set("no").alias("nos")))
    ws.drop("lines", "heads", *(f"{a}-{b}" for a in ("near", "far") for b in ("hits", "more")), *(f"far{k}" for k in range(PASSES)))
    return out


def _row(text: Column, repeated: Column) -> Column:
    """Tells rows of one doc_id apart by their text; 0 where a doc_id has one row."""
    return F.when(repeated, F.xxhash64(text)).otherwise(0)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines of text that match an earlier line taken out; other columns and all rows stay.

    A line without words stays always, as does every line of a row whose doc_id is null; a null text stays null.
    A text may become empty. Of rows that repeat a doc_id, lines that match each other at the same number stay.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    # a table, so that Spark knows its size and doesn't shuffle texts for the few
    repeated = Workspace(docs.sparkSession, "lines").table("repeated", docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", F.lit(True).alias("repeated")))
    own = own.join(repeated, "doc_id", "left").select("doc_id", _row(F.col("text"), F.col("repeated")).alias("row"), "text")
    gone = removed_lines(own).join(repeated, "doc_id", "left").alias("g")
    text = F.col("d.text").cast("string")
    joined = docs.alias("d").join(gone.hint("merge"), (F.col("d.doc_id").cast("long") == F.col("g.doc_id")) & (_row(text, F.col("g.repeated")) == F.col("g.row")), "left")
    split = joined.select("d.*", F.struct(F.col("g.nos").alias("nos"), F.split(text, "\n", -1).alias("lines")).alias(cut := "__cut_" + "_".join(docs.columns)))
    lines, nos = F.col(f"`{cut}`.lines"), F.col(f"`{cut}`.nos")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), nos)
    new = F.when(nos.isNull(), F.col("text").cast("string")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return split.select(*(new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, bytes and digest of the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
