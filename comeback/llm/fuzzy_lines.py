"""Line dedup: equal and similar lines keep one occurrence, DataFrame operations only.

Lines are normalised to their words. SimHashes of distinct lines are cut into four blocks, and
lines that agree in two blocks, or share two of the smallest hashes of two words in a row, are
compared by edit similarity; lines linked this way, directly
or through others, form a group, and only the group's first occurrence stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comeback.llm.common import staged
from comeback.llm.components import connected

WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: Letters of scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han): each counts as a word.
UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
PIECE = rf"[{UNSPACED}]|[a-z0-9\x{{80}}-\x{{10FFFF}}&&[^{UNSPACED}]]+"
BLOCKS, BLOCK_BITS = 4, 16
NO_ID = (1 << 63) - 1
SLOT_BITS = 17
LANES = 16
#: Lines of more characters are hashed apart; those below have fewer than 2^15 words, letters of unspaced scripts included.
LONG = 32_000


@dataclass(frozen=True)
class LineRules:
    """``similarity``: 1 - edits / characters of the longer line. ``min_words``: shorter lines stay.

    ``sketch``: lines are also compared if they share two of so many smallest hashes of two words in
    a row; 0: only if two SimHash blocks are equal, which finds few lines at the similarity limit.
    """

    similarity: float = 0.8
    min_words: int = 5
    sketch: int = 0


#: What ``op8_fuzzy_lines`` and the pipeline use.
WHOLE = LineRules(sketch=8)


def bit_sums(word_hash: Column) -> list[Column]:
    """Aggregates that count how many hashes have each of the 64 bits, four counters to a sum: bits
    i, i + 16, i + 32 and i + 48 are counted in sum i."""
    mask = F.lit(sum(1 << LANES * at for at in range(64 // LANES))).cast("bigint")
    return [F.sum(F.shiftrightunsigned(word_hash, i).bitwiseAND(mask)).alias(f"s{i}") for i in range(LANES)]


def majority(count: Column) -> Column:
    """SimHash: the bits that more than half of ``count`` hashes have, from the sums.

    A counter is above half of the count if adding 2^15 - 1 - half carries into its top bit; three
    counters of a sum are tested at once, the fourth, which has the sign bit, alone.
    """
    half = F.floor(count / 2).cast("bigint")
    low = F.lit(sum(1 << LANES * at for at in range(3))).cast("bigint")
    total = F.lit(0).cast("bigint")
    for i in range(LANES):
        counters = F.col(f"s{i}").bitwiseAND(F.lit((1 << 48) - 1).cast("bigint")) + low * (F.lit((1 << 15) - 1).cast("bigint") - half)
        bits = F.shiftleft(F.shiftrightunsigned(counters, LANES - 1).bitwiseAND(low), i)
        mark = (1 << (48 + i)) - ((i == LANES - 1) << 64)
        top = F.when(F.shiftrightunsigned(f"s{i}", 48) > half, F.lit(mark).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        total = total.bitwiseOR(bits).bitwiseOR(top)
    return total


def long_simhash(hashes: Column, count: Column) -> Column:
    """The same for one array of any size, bit by bit; for lines too long for the counters."""
    total = F.lit(0).cast("bigint")
    for bit in range(64):
        seen = F.aggregate(
            hashes, F.lit(0).cast("bigint"), lambda acc, h: acc + F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(1).cast("bigint"))
        )
        mark = (1 << bit) - ((bit == 63) << 64)
        total = total.bitwiseOR(F.when(seen * 2 > count, F.lit(mark).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return total


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(o, h, text): order of the id (null last), hash of the text, the text."""
    text = docs[text_column].cast("string")
    return docs.select(
        F.coalesce(docs[id_column].cast("bigint"), F.lit(NO_ID)).alias("o"), F.xxhash64(text).alias("h"), text.alias("text")
    )


def _words(line: str) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def _lines(rows: DataFrame, rule: LineRules, long: bool) -> DataFrame:
    """(o, h, at, words) of every line that is so long, or not, and may have enough words.

    Words are counted later: a filter on them would cut the line once more.
    """
    lines = rows.select("o", "h", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    size = F.length("line")
    lines = lines.where(size > LONG if long else (size <= LONG) & (size >= 2 * rule.min_words - 1))
    return lines.select("o", "h", "at", _words("line").alias("words"))


def _sketch(words: str, most: int) -> Column:
    """The smallest hashes of two words in a row, ``most`` at most."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    hashes = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, most)


def _sketch_keys(sketch: str, most: int) -> Column:
    """A key for every two hashes of a sketch."""
    return F.flatten(F.transform(sketch, lambda a, i: F.transform(F.slice(sketch, i + 2, F.lit(most)), lambda b: F.xxhash64(a, b))))


def _hashed(rows: DataFrame, rule: LineRules) -> DataFrame:
    """(o, h, at, f, g, size[, sketch], sim): occurrence, key and SimHash of every line; rows that repeat are one.

    Rows are dealt by (o, h) once, so words are counted where their line stands and not moved. Every
    column but the occurrence is a minimum of equal numbers: keys of a fixed size are much cheaper.
    """
    once = rows.dropDuplicates(["o", "h"])
    keys, marks = ["o", "h", "at"], ["f", "g", "size"]
    lines = _marked(_lines(once, rule, long=False), rule)
    drawn = [F.get("sketch", F.lit(i)).alias(f"k{i}") for i in range(rule.sketch)]
    single = [*marks, *(f"k{i}" for i in range(rule.sketch))]
    # The outer form, as Spark puts a filter on the words before the other.
    words = lines.select(*keys, *marks, *drawn, "words").select(*keys, *single, F.explode_outer("words").alias("word"))
    sums = words.groupBy(*keys).agg(*bit_sums(F.xxhash64("word")), F.count("word").alias("n"), *[F.min(c).alias(c) for c in single])
    sketch = [F.array_compact(F.array(*[f"k{i}" for i in range(rule.sketch)])).alias("sketch")] if rule.sketch else []
    short = sums.where(F.col("n") >= rule.min_words).select(*keys, *marks, *sketch, majority(F.col("n")).alias("sim"))
    rare = rows.where(F.length("text") > LONG).dropDuplicates(["o", "h"])
    whole = _marked(_lines(rare, rule, long=True), rule).where(F.size("words") >= rule.min_words)
    whole = whole.select(*keys, *marks, *(["sketch"] if rule.sketch else []), F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))
    return short.unionByName(whole.select(*[c for c in whole.columns if c not in ("n", "hs")], long_simhash(F.col("hs"), F.col("n")).alias("sim")))


def _marked(lines: DataFrame, rule: LineRules) -> DataFrame:
    """Lines with the key of their words, two hashes, their length, and the sketch if there is one."""
    marked = lines.select("o", "h", "at", "words", F.array_join("words", " ").alias("norm"))
    key = [F.xxhash64("norm").alias("f"), F.xxhash64("norm", F.lit(1)).alias("g"), F.length("norm").alias("size")]
    if rule.sketch:
        key.append(_sketch("words", rule.sketch).alias("sketch"))
    pieces = F.when(F.col("norm").rlike(f"[{UNSPACED}]"), F.regexp_extract_all("norm", F.lit(PIECE), F.lit(0))).otherwise(F.col("words"))
    return marked.withColumn("words", pieces).select("o", "h", "at", "words", *key)


def _bitmap(frame: DataFrame, column: str) -> DataFrame:
    """(slot, mask): a bitmap of hashes, of 2^17 rows at most whatever the number of hashes."""
    return frame.groupBy(F.shiftrightunsigned(column, 64 - SLOT_BITS).alias("slot")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("mask")
    )


def _meet(frame: DataFrame, bitmap: DataFrame, column: str) -> DataFrame:
    """Rows with ``maybe``: whether the hash may be in the bitmap. The broadcast side has a fixed bound."""
    slot = F.shiftrightunsigned(F.col(column), 64 - SLOT_BITS)
    met = frame.join(F.broadcast(bitmap), slot == F.col("slot"), "left")
    bit = F.expr(f"coalesce(shiftrightunsigned(mask, cast({column} & 63 as int)) & 1, 0) = 1")
    return met.withColumn("maybe", bit).drop("slot", "mask")


def _shared_elements(distinct: DataFrame) -> DataFrame:
    """(f, size, sketch): sketches without the hashes that no other line's sketch holds; those make no pair."""
    same = Window.partitionBy("b")
    hashes = distinct.select("f", "size", F.explode("sketch").alias("b"))
    shared = hashes.withColumn("low", F.min("f").over(same)).withColumn("high", F.max("f").over(same)).where("low <> high")
    return shared.groupBy("f", "size").agg(F.sort_array(F.collect_list("b")).alias("sketch"))


def _same(s: str, t: str, rule: LineRules) -> Column:
    """Whether two texts are similar enough.

    The start of the shorter text and a start of the longer one that is longer by the difference of the
    texts can't be further apart than the whole texts: where an alignment of these cuts the longer one
    elsewhere, what follows differs in length by at least as much. Most pairs end there. Before, a fifth
    of the edits is tried, which most similar texts keep to and others pass soon.
    """
    left, right = F.length(s), F.length(t)
    longest = F.greatest(left, right)
    near = F.least(left, right) >= rule.similarity * longest
    allowed = F.floor((1 - rule.similarity) * longest + 1e-9).cast("int")
    part = F.floor(min(1.0, 1.5 * (1 - rule.similarity)) * F.least(left, right)).cast("int")
    start, other = F.left(s, part + F.greatest(F.lit(0), left - right)), F.left(t, part + F.greatest(F.lit(0), right - left))
    within = lambda a, b, most: F.call_function("levenshtein", a, b, most) >= 0
    close = within(F.col(s), F.col(t), F.floor(allowed / 5).cast("int"))
    return F.when(near, close | (within(start, other, allowed) & within(F.col(s), F.col(t), allowed))).otherwise(F.lit(False))


def _similar(pairs: DataFrame, texts: DataFrame, rule: LineRules) -> DataFrame:
    """(a, b, same) for pairs of line hashes, with the nodes' full keys."""
    left = texts.select(F.col("f").alias("x"), F.struct("f", "g").alias("a"), F.col("norm").alias("s"))
    right = texts.select(F.col("f").alias("y"), F.struct("f", "g").alias("b"), F.col("norm").alias("t"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "a", "b", _same("s", "t", rule).alias("same"))


def line_groups(rows: DataFrame, rule: LineRules) -> tuple[DataFrame, DataFrame]:
    """Every line's occurrence (o, h, at, f, g), and for lines that occur more than once or have
    similar ones, the occurrence that stays (f, g, keep)."""
    lines = staged(_hashed(rows, rule), "lines")
    distinct = lines.groupBy("f", "g").agg(
        F.min(F.struct("o", "h", "at")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sim").alias("sim"), F.first("size").alias("size"),
        *([F.first("sketch").alias("sketch")] if rule.sketch else []),
    )
    distinct = staged(distinct, "distinct-lines")

    block = [F.shiftrightunsigned("sim", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("bigint")) for i in range(BLOCKS)]
    keys = [
        F.lit(n << 2 * BLOCK_BITS).cast("bigint") + F.shiftleft(block[i], BLOCK_BITS) + block[j]
        for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    line = [F.col("f").alias("x"), F.col("size").alias("xn")]
    keyed = distinct.select(*line, F.explode(F.array(*keys)).alias("key"))
    if rule.sketch:
        keyed = keyed.unionAll(_shared_elements(distinct).select(*line, F.explode(_sketch_keys("sketch", rule.sketch)).alias("key")))
    same_key = Window.partitionBy("key")
    met = keyed.withColumn("lead", F.min(F.struct("x", "xn")).over(same_key)).withColumn("last", F.max("x").over(same_key))
    met = met.where("lead.x <> last").select("key", "x", "xn", F.col("lead.x").alias("lead"), F.col("lead.xn").alias("ln"))
    met = staged(met, "met")

    # Each line with the first of its key; lines of too different a length can't be similar.
    may = lambda a, b: F.least(a, b) >= rule.similarity * F.greatest(a, b)
    ordered = [F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")]
    led = met.where("x <> lead")
    others = led.select("key", F.col("x").alias("y"), F.col("xn").alias("yn"))
    to_lead = led.where(may("xn", "ln")).select("x", F.col("lead").alias("y"))
    far = led.where(~may("xn", "ln")).select("key", "x", "xn")
    among = far.join(others, "key").where((F.col("x") != F.col("y")) & may("xn", "yn"))
    pairs = staged(to_lead.select(*ordered).unionAll(among.select(*ordered)).distinct(), "pairs")

    # Words of the lines to compare: their first occurrences, found by a bitmap and then exactly.
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("f")).distinct()
    spot = F.xxhash64("o", "h", "at")
    spots = distinct.join(wanted, "f", "left_semi").select("f", "g", "first.*").withColumn("spot", spot)
    here = rows.select("o", "h", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("spot", spot)
    maybe = _meet(here, _bitmap(spots, "spot"), "spot").where("maybe").select("o", "h", "at", "line")
    normal = maybe.select("o", "h", "at", F.array_join(_words("line"), " ").alias("norm"))
    texts = normal.join(spots.drop("spot"), ["o", "h", "at"]).select("f", "g", "norm").dropDuplicates(["f", "g"])
    texts = staged(texts, "texts")

    # Then lines that differ from the first of their key after all, with the others of the key.
    compared = staged(_similar(pairs, texts, rule), "compared")
    apart = compared.where(~F.col("same")).select(F.col("x").alias("p"), F.col("y").alias("q")).distinct()
    first = [F.least("x", "lead").alias("p"), F.greatest("x", "lead").alias("q")]
    rest = led.where(may("xn", "ln")).select("key", "x", "xn", *first).join(apart, ["p", "q"]).select("key", "x", "xn")
    crossed = rest.join(others, "key").where((F.col("x") != F.col("y")) & may("xn", "yn")).select(*ordered).distinct()
    more = _similar(crossed.join(pairs, ["x", "y"], "left_anti"), texts, rule)
    links = compared.where("same").select("a", "b").unionAll(more.where("same").select("a", "b"))
    groups = connected(links).select("node.f", "node.g", F.col("component").alias("group"))

    firsts = groups.join(distinct.select("f", "g", "first"), ["f", "g"])
    kept = firsts.groupBy("group").agg(F.min("first").alias("keep"))
    grouped = groups.join(kept, "group").select("f", "g", "keep")
    copies = distinct.where("copies > 1").join(groups, ["f", "g"], "left_anti").select("f", "g", F.col("first").alias("keep"))
    return lines, staged(grouped.unionByName(copies), "keep")


def repeated_lines(rows: DataFrame, rule: LineRules) -> DataFrame:
    """(o, h, gone): the numbers of the lines to remove, for rows that have any."""
    lines, kept = line_groups(rows, rule)
    here = F.struct("o", "h", "at")
    gone = lines.select("o", "h", "at", "f", "g").join(kept, ["f", "g"]).where(here != F.col("keep"))
    return gone.groupBy("o", "h").agg(F.collect_set("at").alias("gone"))


def without_repeated_lines(
    docs: DataFrame, rule: LineRules | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of their text, and two more columns,
    ``lines_in`` and ``lines_removed`` (which replace columns of these names).

    Occurrences are ordered by id (null last), text hash and line number. Lines with fewer than
    ``min_words`` words stay, copies included; a letter of a script without spaces counts as a word,
    and lines have 2 ``min_words`` - 1 characters at least. A null text stays null and has no lines, an empty one has one line;
    rows that repeat both id and text are treated as one document and come out alike. All other
    columns are carried along.
    """
    rule = rule or LineRules()
    rows = _rows(docs, id_column, text_column)
    gone = staged(repeated_lines(rows, rule), "gone")
    packed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(docs[id_column].cast("bigint"), F.lit(NO_ID)).alias("o"),
        F.xxhash64(docs[text_column].cast("string")).alias("h"),
    )
    text = F.col("row").getField(text_column)
    # Rows that can't have a line to remove aren't moved.
    met = _meet(packed, _bitmap(gone, "h"), "h")
    touched = met.where("maybe").join(gone, ["o", "h"], "left").select("row", "gone")
    untouched = met.where(~F.col("maybe")).select("row", F.lit(None).cast("array<int>").alias("gone"))
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: lines[i]), "\n")
    out = touched.unionByName(untouched).select(
        *[
            (F.when(F.col("gone").isNull(), text).otherwise(kept) if c == text_column else F.col("row").getField(c)).alias(c)
            for c in docs.columns
            if c not in ("lines_in", "lines_removed")
        ],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("lines_in"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("lines_removed"),
    )
    return out
