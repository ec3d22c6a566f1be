"""Phrases of a language's texts by best-first branch and bound over prefixes.

Texts are cut into pieces at punctuation and line ends, pieces into words; a
phrase is a run of words inside a piece. Its score compares how often it occurs
(``a``) with its two parts at a cut (``l``, ``r``): floor(SCALE * a / (l + r)), at
the cut where that is lowest.

Whatever is grown from a prefix with count P occurs at most P times and its right
part at least as often as itself, so with f the count of the prefix' first word no
phrase below it scores more than floor(SCALE * P / (f + P)), nor has a higher
count than P. The same holds from the other end. Phrases are ranked by (score, a),
so a prefix whose (bound, P) ranks below the place being looked for grows nothing
of use.

1. Words are counted, then pairs of words that are frequent enough.
2. Per language a rank is set at which some multiple of the phrases wanted stand.
   The frontier above it - every prefix, or by symmetry suffix, whose bound reaches
   it - is grown by one word, level by level. That yields every phrase of that rank,
   the counts of all its parts, and of all phrases one word longer than it, which
   tell whether it is dropped.
3. A language with enough phrases left is settled: nothing unseen can rank above.
   For the others the rank is lowered, at last to none, and the frontier grown on.

A level's phrases are counted by a scan of the texts that leaves out what bit sets
of fixed size rule out: a full bit set only lets more through to the exact counts.
Words are told apart by 64-bit hashes of language and folded bytes, phrases by the
hashes of their words; texts are looked up for the ranked phrases alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from holdfast.llm import bloom
from holdfast.llm.text import LOWER, U64, mix, released, slices, span_hashes, word_spans
from holdfast.session import drop, land, scratch_path

SCALE = 2_000_000
LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words
TOP = 2000
HOLDS = 80  # percent of its occurrences in a longer candidate that drop a phrase
CHUNK_BYTES = 8 << 20  # of text whose phrases a worker counts at once
BATCH = 1 << 16  # rows handed to Spark at a time
WIDEN = (4, 64, None)  # multiples of TOP at which a language's rank is set in turn; None: no rank
_BREAKS = [0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, *range(0x0A, 0x0E)]  # fixed values
_IS_BREAK = np.isin(np.arange(256), _BREAKS)
_IN_WORD = ~np.isin(np.arange(256), [*_BREAKS, 0x20, 0x09])


def _names(size: int) -> list[str]:
    return [f"w{i}" for i in range(1, size + 1)]


def _grow(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a phrase's prefix, one word on."""
    return ((key << U64(1)) | (key >> U64(63))) ^ word


def _key(words: list[str]) -> Column:
    """The same key in Spark."""
    out = F.col(words[0])
    for w in words[1:]:
        out = F.shiftleft(out, 1).bitwiseOR(F.shiftrightunsigned(out, 63)).bitwiseXOR(F.col(w))
    return out


class Words:
    """Words of a slice in order: hash with the language, and whether the next one follows in the same piece."""

    def __init__(self, batch: pa.RecordBatch, low: int, high: int, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends = word_spans(data, offsets, _IN_WORD)
        first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(low, high), np.diff(first))
        language = np.asarray(batch.column("lang_key")).view(U64)
        self.key = mix(span_hashes(data, self.starts, self.ends) ^ language[self.row])
        breaks = np.cumsum(_IS_BREAK[data], dtype=np.int64)
        self.follows = np.zeros(len(self.key), dtype=bool)
        if len(self.key) > 1:
            between = breaks[self.starts[1:]] == breaks[self.ends[:-1] - 1]
            self.follows[:-1] = between & (self.row[1:] == self.row[:-1])


def _tally(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases with their numbers."""
    key = columns[0]
    for c in columns[1:]:
        key = _grow(key, c)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
    if n is None:
        total = np.diff(np.r_[first, len(key)])
    else:
        total = np.add.reduceat(n[order], first) if len(key) else n
    at = order[first]
    return [c[at] for c in columns], total


def _counting(size: int, places: Callable[[Words], np.ndarray]):
    """Counts of the phrases of ``size`` words that begin at ``places``, chunk by chunk."""

    def flushed(found: list) -> Iterator[pa.RecordBatch]:
        columns, n = [np.concatenate(c) for c in zip(*(x[0] for x in found))], np.concatenate([x[1] for x in found])
        found.clear()
        columns, n = _tally(columns, n)
        for low in range(0, len(n), BATCH):
            part = [pa.array(c[low : low + BATCH].view(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([*part, pa.array(n[low : low + BATCH])], names=[*_names(size), "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, filled = [], 0
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                words = Words(batch, low, high, data, offsets)
                at = places(words)
                found.append(_tally([words.key[at + i] for i in range(size)]))
                filled += len(data)
                if filled > CHUNK_BYTES:
                    yield from flushed(found)
                    filled = 0
        if found:
            yield from flushed(found)

    return released(run)


def _counting_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their language and number, slice by slice; a row without a word has the number of all words."""
    names = ["w1", "lang", "n"]
    for batch in batches:
        langs = batch.column("lang").cast(pa.string()).dictionary_encode()
        code = np.asarray(langs.indices)
        for low, high, data, offsets in slices(batch.column("text")):
            words = Words(batch, low, high, data, offsets)
            key, at, n = np.unique(words.key, return_index=True, return_counts=True)
            spoken = langs.dictionary.take(pa.array(code[words.row[at]]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), spoken, pa.array(n)], names=names)
            total = np.bincount(code[words.row], minlength=len(langs.dictionary))
            nothing = pa.nulls(len(total), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, langs.dictionary, pa.array(total.astype(np.int64))], names=names)


def _bits(shared) -> np.ndarray:
    return np.frombuffer(shared.value, dtype=np.uint8)


def _inside(shared, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per place, whether the key at one of the places ``at`` may be in a bit set."""
    out = np.zeros(len(key), dtype=bool)
    out[at] = bloom.may_contain(_bits(shared), key[at])
    return out


def _pairs(frequent) -> Callable[[Words], np.ndarray]:
    def places(words: Words) -> np.ndarray:
        good = bloom.may_contain(_bits(frequent), words.key)
        return np.flatnonzero(good[:-1] & good[1:] & words.follows[:-1]) if len(good) else np.zeros(0, np.int64)

    return places


def _longer(size: int, pairs, prefixes, suffixes, settled) -> Callable[[Words], np.ndarray]:
    """Places of phrases of ``size`` words whose pairs are all frequent, and that the frontier
    reaches. At the last level both ends must be in the frontier, or one end to be settled."""

    def places(words: Words) -> np.ndarray:
        n = len(words.key)
        if n < size:
            return np.zeros(0, np.int64)
        after = lambda x, i: np.r_[x[i:], np.zeros(min(i, n), dtype=x.dtype)]
        follows = np.flatnonzero(words.follows)
        two = _grow(words.key, after(words.key, 1))
        good = _inside(pairs, two, follows)
        whole = good.copy()  # the pairs of a part, one word shorter than the phrase
        for i in range(1, size - 2):
            whole &= after(good, i)
        part = two
        for i in range(2, size - 1):
            part = _grow(part, after(words.key, i))
        at = np.flatnonzero(whole)
        front, back = _inside(prefixes, part, at), _inside(suffixes, part, at)
        if settled is None:
            hit = front | after(back, 1)
        else:
            done = _inside(settled, part, at)
            hit = (front & after(back, 1)) | done | after(done, 1)
        return np.flatnonzero(hit & good & whole & after(whole, 1))

    return places


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def _ratio(a: Column, whole: Column) -> Column:
    """floor(SCALE * a / whole) in exact arithmetic."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * _wide(a), whole)


class _Miner:
    def __init__(self, docs: DataFrame, least: int, longest: int, top: int, holds: int):
        self.spark = docs.sparkSession
        self.least, self.longest, self.top, self.holds = least, longest, top, holds
        lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
        self.texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.col("text").cast("string").alias("text"))
        self.paths: list[str] = []

    def land(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, label))
        return land(df, self.paths[-1])

    def bits(self, keys: DataFrame):
        return self.spark.sparkContext.broadcast(bloom.build(keys, "key"))

    def words(self) -> DataFrame:
        """(w1, lang, a) of frequent words; without a word, the number of all of a language."""
        rows = self.texts.mapInArrow(released(_counting_words), "w1 long, lang string, n long")
        total = rows.groupBy("w1", "lang").agg(F.sum("n").alias("a"))
        return total.filter((F.col("a") >= self.least) | F.col("w1").isNull())

    def counted(self, size: int, places) -> DataFrame:
        """(w1, .., a) of frequent phrases. Tasks have added up theirs, so Spark does not try once more before the shuffle."""
        names = _names(size)
        rows = self.texts.mapInArrow(_counting(size, places), ", ".join(f"{c} long" for c in [*names, "n"]))
        return rows.repartition(*names).groupBy(*names).agg(F.sum("n").alias("a")).filter(F.col("a") >= self.least)

    def scored(self, level: DataFrame, size: int) -> DataFrame:
        """Score at the lowest cut, and the bounds of what grows from a phrase's front and back.

        ``fronts`` and ``backs`` hold the counts of the shorter prefixes and suffixes.
        """
        cut = lambda k: F.struct(
            _ratio(F.col("a"), _wide(F.element_at("fronts", k)) + _wide(F.element_at("backs", size - k))).alias("score"),
            k.alias("k"),
            F.element_at("fronts", k).alias("l"),
            F.element_at("backs", size - k).alias("r"),
        )
        lowest = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(size - 1)), cut))
        known = F.col("fronts").isNotNull() & F.col("backs").isNotNull()
        bound = lambda counts: _ratio(F.col("a"), _wide(F.element_at(counts, 1)) + _wide(F.col("a")))
        out = level.withColumn("cut", F.when(known, lowest))
        out = out.withColumn("score", F.col("cut.score")).withColumn("l", F.col("cut.l")).withColumn("r", F.col("cut.r"))
        return out.drop("cut").withColumns({"ahead": bound("fronts"), "behind": bound("backs"), "key": _key(_names(size))})

    def pairs(self, words: DataFrame) -> DataFrame:
        shared = self.bits(words.withColumnRenamed("w1", "key"))
        counts = self.counted(2, _pairs(shared))
        front = words.select("w1", "lang", F.array("a").alias("fronts"))
        back = words.select(F.col("w1").alias("w2"), F.array("a").alias("backs"))
        return self.land(self.scored(counts.join(front, "w1").join(back, "w2"), 2), "pairs")

    def ranks(self, pairs: DataFrame, times: int | None) -> DataFrame:
        """Per language the rank (from_score, from_a) at which ``times`` * top pairs stand; zeros without one.

        Pairs are counted in cells of (score, a): thousands of scores, and their
        multiples apart by powers of two of a.
        """
        if times is None:
            return pairs.select("lang").distinct().select("lang", F.lit(0).alias("from_score"), F.lit(0).alias("from_a"))
        even = F.col("score") % 1000 == 0
        cells = pairs.select(
            "lang",
            F.when(even, F.col("score")).otherwise(F.col("score") - F.col("score") % 1000 + 1).alias("from_score"),
            F.when(even, F.expr("shiftleft(1L, cast(floor(log2(a)) as int))")).otherwise(F.lit(0)).alias("from_a"),
        )
        cells = cells.groupBy("lang", "from_score", "from_a").agg(F.count(F.lit(1)).alias("n"))
        down = Window.partitionBy("lang").orderBy(F.desc("from_score"), F.desc("from_a"))
        cells = cells.withColumn("till", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        edge = F.max(F.when(F.col("till") >= times * self.top, F.struct("from_score", "from_a")))
        return cells.groupBy("lang").agg(edge.alias("edge")).select(
            "lang", *[F.coalesce(F.col(f"edge.{c}"), F.lit(0)).alias(c) for c in ("from_score", "from_a")]
        )

    def ranked(self, pairs: DataFrame, ranks: DataFrame) -> DataFrame:
        """All phrases of each language from its rank on that no longer candidate holds."""
        edge = F.struct(F.col("from_score").cast("long").alias("s"), F.col("from_a").cast("long").alias("c"))
        from_on = lambda c: F.struct(F.col(c).cast("long").alias("s"), F.col("a").alias("c")) >= edge
        level, size, survivors = pairs.join(ranks, "lang"), 2, []
        shared = {"pairs": self.bits(level)}
        while True:
            here = level.filter(from_on("score"))
            names = _names(size)
            found = here.select("lang", F.array(*names).alias("words"), "score", "a", "l", "r", "key")
            if size == self.longest:
                survivors.append(found.drop("key"))
                break
            fronts = self.bits(level.filter(from_on("ahead")))
            backs = self.bits(level.filter(from_on("behind")))
            settled = self.bits(here) if size + 1 == self.longest else None
            counts = self.land(self.counted(size + 1, _longer(size + 1, shared["pairs"], fronts, backs, settled)), "longer")
            wider = _names(size + 1)
            held = counts.select(F.explode(F.array(_key(wider[:-1]), _key(wider[1:]))).alias("key"), F.col("a").alias("more"))
            held = held.groupBy("key").agg(F.max("more").alias("more"))
            kept = F.col("more").isNull() | (_wide(F.col("more")) * 100 < _wide(F.col("a")) * self.holds)
            survivors.append(found.join(held, "key", "left").filter(kept).drop("key", "more"))
            grown = lambda side: F.concat(side, F.array("a"))
            prefix = level.select(*names, grown("fronts").alias("fronts"), "lang", "from_score", "from_a")
            # a phrase reached from behind alone has no score, but is the back of others
            spoken = [F.col(c).alias(f"{c}_") for c in ("lang", "from_score", "from_a")]
            suffix = level.select(*[F.col(n).alias(w) for n, w in zip(names, wider[1:])], grown("backs").alias("backs"), *spoken)
            longer = counts.join(prefix, names, "left").join(suffix, wider[1:], "left")
            either = {c: F.coalesce(c, f"{c}_") for c in ("lang", "from_score", "from_a")}
            longer = longer.withColumns(either).drop(*[f"{c}_" for c in either])
            level, size = self.land(self.scored(longer, size + 1), "level"), size + 1
        out = survivors[0]
        for more in survivors[1:]:
            out = out.union(more)
        return self.land(out, "ranked")

    def spelled(self, phrases: DataFrame) -> DataFrame:
        """Phrases with their words' texts, looked up in a scan."""
        words = phrases.select(F.explode("words").alias("key")).distinct()
        spelling = self.texts.mapInArrow(_spelling(self.bits(words)), "word_key long, word string")
        spelling = spelling.join(words.withColumnRenamed("key", "word_key"), "word_key", "left_semi")
        spelling = spelling.groupBy("word_key").agg(F.min("word").alias("word"))
        each = phrases.select("words", F.posexplode("words").alias("at", "word_key")).join(spelling, "word_key")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
        return phrases.join(each.groupBy("words").agg(text.alias("phrase")), "words")


def _spelling(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                words = Words(batch, low, high, data, offsets)
                at = np.flatnonzero(bloom.may_contain(_bits(shared), words.key))
                key, first = np.unique(words.key[at], return_index=True)
                starts, ends = words.starts[at[first]], words.ends[at[first]]
                texts = [LOWER[data[x:y]].tobytes().decode() for x, y in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(texts, pa.string())], names=["word_key", "word"]
                )

    return released(run)


def mine(
    docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, holds: int = HOLDS
) -> DataFrame:
    """The ``top`` phrases of each language of ``docs`` (text, lang), by score, count and text.

    lang, rank (from 1), phrase, a (its occurrences), l and r (those of its parts at
    the lowest-scoring cut, the first of equals), n (all words of the language), score.

    Phrases have 2 to ``longest`` words and occur ``least`` times or more. One that
    lies inside a longer such phrase with at least ``holds`` % of its occurrences is
    left out. Null languages count as ``und``, null texts as empty; repeated rows
    count each. Ties in score and count go by the phrase's bytes. An empty table, and
    a language without candidates, give no rows. Other columns are not looked at.
    """
    miner = _Miner(docs, least, longest, top, holds)
    spark = miner.spark
    words = miner.land(miner.words(), "words")
    totals = words.filter("w1 IS NULL").select("lang", F.col("a").alias("n"))
    pairs = todo = miner.pairs(words.filter("w1 IS NOT NULL"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    rounds = []
    for times in WIDEN:
        ranks = miner.land(miner.ranks(todo, times), "ranks")
        found = miner.ranked(todo, ranks)
        left = found.groupBy("lang").agg(F.count(F.lit(1)).alias("left"))
        open_ = ranks.join(left, "lang", "left").filter((F.coalesce("left", F.lit(0)) < top) & (F.col("from_score") > 0))
        open_ = miner.land(open_.select("lang"), "open")
        settled = found.join(open_, "lang", "left_anti")
        rounds.append(settled.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place"))
        if open_.isEmpty():
            break
        todo = pairs.join(open_, "lang", "left_semi")
    finalists = rounds[0]
    for more in rounds[1:]:
        finalists = finalists.union(more)
    finalists = miner.land(finalists, "finalists")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = miner.spelled(finalists).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")]
    result = land(out.join(totals, "lang").select(*columns), scratch_path(spark, "phrases"))
    drop(spark, *miner.paths)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
size AS (SELECT unnest([1, 2, 3, 4]) AS k),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, size WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT c.lang, c.k, c.g, c.a, j AS cut, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN f y ON y.lang = c.lang AND y.g = c.g[j + 1:c.k]),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
part AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: g[i:i + m - 1])))) AS g FROM f WHERE k > 2),
inside AS (SELECT lang, g, max(a) AS more FROM part GROUP BY lang, g),
kept AS (SELECT low.*, array_to_string(g, ' ') AS phrase FROM low LEFT JOIN inside USING (lang, g)
  WHERE more IS NULL OR 100 * more < 80 * low.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""
