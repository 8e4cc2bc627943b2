"""N-gram Jaccard join by token-combination prefixes, as exact components of linked documents.

A document is the set of its k-word shingles (tokens); two link where their Jaccard similarity
reaches num/den. Tokens have one global order: rare ones first, then the frequent classes, rarer
first. Linked sets share the first tokens of their intersection inside their prefixes: the first
``n - t + 1`` tokens hold the first shared token and the first ``n - t + 2`` the first two, where
``t`` is the least overlap that a set of ``n`` can link with. So a set is indexed by the rare
tokens of its prefix alone, and for the frequent ones, each with which begins a combination, by the
pairs that it forms with the later tokens of the prefix extended by one. Any link between different
sets shares a key; passages that thousands of documents share form no group of their own unless the
pair of tokens heads both documents.

1. Every text becomes its set's size and 128-bit digest; equal sets are one class from here on.
   The same pass counts frequent tokens by lossy counting: tokens that recur in a buffer of
   ``BUFFER`` tokens are summed, and those of a share above 2**-19 of all tokens, at most 2**19 of
   them, make the frequent classes. They steer the order only; any order gives the same links.
   How many sets hold a token that is not frequent is bounded by 2**-18 of all tokens and a few a task.
2. Extended prefixes (longer than the prefix by its share ``extra``) drop the sets that can't link.
   Keys that two or more of the rest share make edges, and their connected components are the
   groups of classes that can link. Sets go by 64 bits of their digest here, which saves a third
   of the shuffle; sets that agree in these and differ otherwise are found by an aggregation and
   kept apart from there on, so a clash of hashes loses no link.
3. The sets of a group meet in one task, each shipped once, where links are verified exactly and
   merged. A group of more than ``GROUP_TOKENS`` is cut by size and hash into pieces below that;
   pairs of pieces whose sizes can link meet in tasks of their own, and the pieces' links are
   merged by connected components again.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing;
fewer words than k make one shingle of the whole sequence; a text of any length is taken whole; keys
of any type that has an order will do, also under a name like the results' inner ones; rows with a null
key are returned with their size, and their component is that of their equals, null if those have no
key either; repeated rows link with each other, and rows of one key with different texts are judged
by text; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import connected_components, cut
from quarry.llm.textvec import fingerprint, mix, release, releasing, shingle_sets

#: Tokens that lossy counting holds at once (16 MB).
BUFFER = 1 << 21
#: Times that a token recurs in a buffer to be counted, and counted in all to be frequent, at least.
LOCAL_MIN, GLOBAL_MIN = 4, 64
#: Frequent tokens, at most.
FREQUENT = 1 << 19
#: Tokens of the sets that meet in a task, at most, but for a single larger set.
GROUP_TOKENS = 1_000_000
#: Tokens of a task's sets from which on it gives its memory back at its end.
RELEASE_TOKENS = 1 << 17
#: Rows of classes and tasks that are broadcast to fetch their texts (about 60 bytes each), at most.
BROADCAST_CLASSES = 300_000
#: Keys of rows to remove that are broadcast, at most (about 100 bytes each).
BROADCAST_ROWS = 500_000


def least_overlap(n: int, num: int, den: int) -> int:
    """The smallest overlap that a set of n tokens can link with."""
    return -(-n * num // den)


def assured(n: int, num: int, den: int, extra: float) -> int:
    """How many of the first shared tokens of any link the extended prefix of a set of n tokens holds; never less for a larger n."""
    t = least_overlap(n, num, den)
    return min(1 + -int(-(n - t + 1) * extra // 1), t)


def _summaries(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Rows (kind 0, key, n, d1, d2) of documents and (kind 1, null, count, token, 0) of tokens that recur in a buffer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        seen: set[tuple[int, int]] = set()

        def rows(kind: int, ids, n, one, two) -> pa.RecordBatch:
            m = len(n)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, kind, dtype=np.int32)), ids, pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                names=["kind", "id", "n", "d1", "d2"],
            )

        def counted() -> Iterator[pa.RecordBatch]:
            if held:
                tokens, n = np.unique(np.concatenate(held), return_counts=True)
                often = n >= LOCAL_MIN
                yield rows(1, pa.nulls(int(often.sum()), id_type), n[often].astype(np.int64), tokens[often].view(np.int64), np.zeros(int(often.sum()), dtype=np.int64))

        for batch in batches:
            sizes, ones, twos = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for row, tokens in shingle_sets(batch.column(1), k):
                if len(tokens):
                    sizes[row] = len(tokens)
                    ones[row], twos[row] = pair = fingerprint(tokens)
                    if pair not in seen:
                        seen.add(pair)
                        held.append(tokens)
                        size += len(tokens)
                if size >= BUFFER:
                    yield from counted()
                    held, size, seen = [], 0, set()
            yield rows(0, batch.column(0), sizes, ones, twos)
        yield from counted()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[key].dataType)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(releasing(run), f"kind int, id {kind}, n bigint, d1 bigint, d2 bigint")


def _frequent(counted: DataFrame, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequent tokens ascending, class of each: the binary digits of its count)."""
    least = max(GLOBAL_MIN, tokens // FREQUENT + 1)
    rows = counted.groupBy("d1").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = [(r["d1"], r["n"].bit_length()) for r in rows.toLocalIterator()]  # at most FREQUENT rows, by the threshold
    table = np.array([t for t, _ in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(table)
    return table[order], np.array([c for _, c in found], dtype=np.int64)[order]


#: Kinds of index rows: a rare token of the extended prefix only, one of the prefix itself, a pair of tokens.
EXTENDED, SINGLE, PAIR = 0, 1, 2


def index_rows(tokens: np.ndarray, frequent: np.ndarray, classes: np.ndarray, num: int, den: int, extra: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, kinds, need) of a set: its index rows, and how many rare tokens of its extended prefix others must hold in theirs."""
    n = len(tokens)
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), 0
    if n * den < (n + 1) * num:  # too small to link with any set but its equals
        return none
    t = least_overlap(n, num, den)
    first = n - t + 1
    reach = n - t + assured(n, num, den, extra)
    rare, common = tokens, tokens[:0]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
        if often.any():
            rare, common = tokens[~often], tokens[often]
            common = common[np.argsort(classes[at[often]], kind="stable")]
    head = rare[:reach]
    kinds = np.where(np.arange(len(head)) < first, SINGLE, EXTENDED).astype(np.int32)
    # A link's first shared tokens are in both prefixes, as many as the smaller one assures: t is the least size that links.
    need = min(assured(t, num, den, extra), len(rare) - (n - t))
    if len(rare) >= first:
        return head, kinds, need
    ranked = np.concatenate([rare, common])[: first + 1]
    left, right = np.triu_indices(len(ranked) - len(rare), 1)
    left, right = ranked[len(rare) + left], ranked[len(rare) + right]
    with np.errstate(over="ignore"):
        pairs = mix(left * np.uint64(0xD6E8FEB86659FD93) + mix(right))
    # An overlap of one token has no pair: only sets of a least overlap of one can have such a link.
    alone = ranked[len(rare) : first] if t == 1 else ranked[:0]
    more = np.concatenate([pairs, alone])
    return np.concatenate([head, more]), np.concatenate([kinds, np.full(len(more), PAIR, dtype=np.int32)]), need


def _index(docs: DataFrame, text: str, k: int, num: int, den: int, extra: float, frequent: np.ndarray, classes: np.ndarray) -> DataFrame:
    """(key, d1, mark) of every distinct set; the mark is four times the need, and the kind."""
    held = docs.sparkSession.sparkContext.broadcast((frequent, classes))  # at most FREQUENT entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, owners, marks = [], [], []
            for _, tokens in shingle_sets(batch.column(0), k):
                if len(tokens):
                    digest = fingerprint(tokens)
                    if digest not in seen:
                        seen.add(digest)
                        some, kind, need = index_rows(tokens, *held.value, num, den, extra)
                        keys.append(some)
                        marks.append(kind + np.int32(4 * max(need, 0)))
                        owners.append(np.full(len(some), digest[0], dtype=np.int64))
            if keys:
                columns = [pa.array(np.concatenate(keys).view(np.int64)), *[pa.array(np.concatenate(x)) for x in (owners, marks)]]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "d1", "mark"])

    return docs.select(text).mapInArrow(releasing(run), "key bigint, d1 bigint, mark int")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of the keys that two sets or more hold, each once."""
    by_key = W.partitionBy("key")
    return rows.withColumns({"low": F.min("d1").over(by_key), "high": F.max("d1").over(by_key)}).filter("low <> high").drop("low", "high").dropDuplicates(["key", "d1", "mark"])


def _enough(rows: DataFrame) -> DataFrame:
    """Rows of the sets that hold as many shared keys as they need."""
    return rows.withColumn("__n", F.count("*").over(W.partitionBy("d1"))).filter(F.col("__n") >= F.col("need")).drop("__n")


def _candidates(index: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect the sets that can link.

    Rare tokens meet by key; how many sets hold one is bounded by what makes a token frequent. A set
    whose extended prefix has too few tokens in common with others' can't link and falls out, and
    once more among those left. Inside a key, sets are chained in order of size where neighbours'
    sizes can link. Pairs of frequent tokens may be held by any number of sets: they are reduced by
    aggregation to stars.
    """
    rare = index.filter(F.col("mark") % 4 < PAIR).withColumn("need", F.floor(F.col("mark") / 4).cast("int"))
    once = cut(_enough(_shared(rare)))
    left = _shared(_enough(_shared(once)).filter(F.col("mark") % 4 == SINGLE)).select("key", "d1").distinct().join(sizes, "d1")
    by_size = W.partitionBy("key").orderBy("n", "d1")
    chained = left.select("d1", "n", F.lag("d1").over(by_size).alias("d0"), F.lag("n").over(by_size).alias("n0"))
    chains = chained.filter((F.col("n0") * den >= F.col("n") * num) & (F.col("d0") != F.col("d1"))).select(F.col("d1").alias("a"), F.col("d0").alias("b"))
    pairs = cut(index.filter(F.col("mark") % 4 == PAIR).select("key", "d1"))
    shared = pairs.groupBy("key").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).filter("low <> high")
    stars = pairs.join(shared, "key").filter("d1 <> low").select(F.col("d1").alias("a"), F.col("low").alias("b"))
    return chains.unionByName(stars)


def link(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The first place of each set's component under exact links: an in-memory prefix join that checks only sets not yet joined."""
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    component = np.arange(len(sets))
    members = {i: [i] for i in range(len(sets))}
    sizes = np.array([len(s) for s in sets])
    index: dict[int, array] = {}
    for i in np.argsort(sizes, kind="stable").tolist():
        mine, n = sets[i], len(sets[i])
        at = np.searchsorted(every, mine)
        prefix = at[np.lexsort((at, counts[at]))][: n - least_overlap(n, num, den) + 1]
        prefix = prefix[counts[prefix] > 1].tolist()
        near = [np.frombuffer(index[token], dtype=np.int64) for token in prefix if token in index]
        if near:
            some = np.unique(np.concatenate(near))
            for j in some[sizes[some] * den >= n * num].tolist():
                if component[j] != component[i]:
                    other = sets[j]
                    place = np.searchsorted(mine, other)
                    place[place == n] = n - 1
                    shared = int((mine[place] == other).sum())
                    if shared * den >= (n + len(other) - shared) * num:
                        few, many = sorted((int(component[i]), int(component[j])), key=lambda c: len(members[c]))
                        members[many] += members.pop(few)
                        component[members[many]] = many
        del near
        for token in prefix:
            index.setdefault(token, array("q")).append(i)
    for group in members.values():
        component[group] = min(group)
    return component


def _verified(groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): each class, by its number, and the root of its component in the task; ``groups`` has label, task, c, text, d1, d2."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, np.ndarray] = {}
        texts = pa.array(pdf["text"], pa.string())
        for row, tokens in shingle_sets(texts, k):
            if fingerprint(tokens) == (pdf["d1"].iat[row], pdf["d2"].iat[row]):  # a key may have other texts
                held[pdf["c"].iat[row]] = tokens
        ids = sorted(held)
        roots = link([held[c] for c in ids], num, den) if ids else []
        if sum(map(len, held.values())) > RELEASE_TOKENS:
            held.clear()
            release()
        return pd.DataFrame({"a": ids, "b": [ids[r] for r in roots]}, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})

    return groups.select("label", "task", "c", "text", "d1", "d2").groupBy("label", "task").applyInPandas(run, "a bigint, b bigint")


def _tasks(classes: DataFrame, num: int, den: int, group_tokens: int) -> tuple[DataFrame, bool]:
    """``classes`` (label, c, id, n, d1, d2) with the tasks where each takes part, and whether any group was cut."""
    whole = classes.groupBy("label").agg(F.sum("n").alias("tokens"))
    large = cut(whole.filter(F.col("tokens") > group_tokens))
    if large.isEmpty():
        return classes.withColumn("task", F.lit("")), False
    # Sizes that link differ by the ratio num/den at most, so by one step of that ratio's logarithm.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    split = classes.join(large.select("label"), "label", "left_semi").withColumn("step", step)
    pieces = split.groupBy("label", "step").agg(F.ceil(F.sum("n") / group_tokens).cast("int").alias("pieces"))
    near = [pieces.select("label", (F.col("step") - d).alias("step"), F.col("pieces").alias(f"p{d}")) for d in (-1, 0, 1)]
    joined = split.join(near[1], ["label", "step"]).join(near[0], ["label", "step"], "left").join(near[2], ["label", "step"], "left")
    own = F.pmod("d2", F.col("p0")).cast("int")
    one = lambda a, x, b, y: F.concat_ws("/", a, x, b, y)
    seq = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    here = F.transform(seq(F.col("p0")), lambda x: one(F.col("step"), F.least(x, "own"), F.col("step"), F.greatest(x, "own")))
    above = F.transform(seq(F.col("p1")), lambda x: one(F.col("step"), F.col("own"), F.col("step") + 1, x))
    below = F.transform(seq(F.col("p-1")), lambda x: one(F.col("step") - 1, x, F.col("step"), F.col("own")))
    dealt = joined.withColumn("own", own).withColumn("task", F.explode(F.concat(here, above, below)))
    rest = classes.join(large.select("label"), "label", "left_anti").withColumn("task", F.lit(""))
    return rest.unionByName(dealt.select(*rest.columns)), True


def _components(docs: DataFrame, key: str, text: str, k: int, num: int, den: int, extra: float, group_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: id, n, d1, d2; classes: d1, d2, id; links: d1, d2, r1, r2, component of the classes that links join, r1 and r2 their root's digest)."""
    summaries = cut(_summaries(docs, key, text, k))
    rows = summaries.filter("kind = 0").select("id", "n", "d1", "d2")
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    frequent, ranks = _frequent(summaries.filter("kind = 1"), tokens)
    full = rows.filter("n > 0")
    classes = full.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    edges = _candidates(_index(docs, text, k, num, den, extra, frequent, ranks), full.select("d1", "n").distinct(), num, den)
    groups = connected_components(edges)
    clashes = classes.groupBy("d1").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("d1").alias("node"), F.col("d1").alias("label"))
    groups = groups.unionByName(clashes.join(groups.select("node"), "node", "left_anti"))
    grouped = classes.join(groups, classes["d1"] == groups["node"]).filter("id is not null")
    grouped = cut(grouped.select("label", F.monotonically_increasing_id().alias("c"), "id", "n", "d1", "d2"))
    dealt, was_cut = _tasks(grouped, num, den, group_tokens)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    few = dealt.count() <= BROADCAST_CLASSES
    found = _verified(texts.join(F.broadcast(dealt) if few else dealt, "id"), k, num, den)
    if was_cut:
        merged = connected_components(found)
        found = merged.select(F.col("node").alias("a"), F.col("label").alias("b"))
    else:
        together = found.groupBy("b").agg(F.count("*").alias("m")).filter("m > 1").select("b")
        found = found.join(together, "b")
    linked = cut(grouped.join(found, grouped["c"] == found["a"]).select("d1", "d2", "c", "b", "id"))
    roots = linked.groupBy("b").agg(F.min("id").alias("component"), F.min_by(F.struct("d1", "d2"), "c").alias("root"))
    return rows, classes, linked.join(roots, "b").select("d1", "d2", F.col("root.d1").alias("r1"), F.col("root.d2").alias("r2"), "component")


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5, extra: float = 0.5, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key that links reach from it."""
    rows, classes, links = _components(docs, key, text, k, num, den, extra, group_tokens)
    by_class = classes.join(links, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    out = rows.filter("n > 0").join(by_class, ["d1", "d2"]).select("id", "n", "component_id")
    empty = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(empty).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5, extra: float = 0.5, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One document of each component, that of the smallest key and, for a repeated key, of the smallest set's digest.

    What goes is chosen among keys and digests; texts move only where the rows to remove are more
    than ``BROADCAST_ROWS``, or where a key repeats. Rows that link with nothing stay, as do rows with
    a null key; of rows equal in key and set that link or repeat, the one smallest by all columns stays.
    """
    rows, _, links = _components(docs, key, text, k, num, den, extra, group_tokens)
    named = rows.filter("n > 0 and id is not null")
    joined = named.join(links, ["d1", "d2"], "left").select("id", "d1", "d2", F.coalesce("r1", "d1").alias("r1"), F.coalesce("r2", "d2").alias("r2"))
    first = joined.groupBy("r1", "r2").agg(F.min(F.struct("id", "d1", "d2")).alias("one"), F.count("*").alias("m")).filter("m > 1").drop("m")
    # Components of several rows: all rows of a key that holds only removed sets go by key alone.
    members = cut(joined.join(first, ["r1", "r2"]).withColumn("goes", F.struct("id", "d1", "d2") != F.col("one")).select("id", "d1", "d2", "goes"))
    repeated = rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("m")).filter("m > 1").select("id")
    gone = cut(members.filter("goes").select("id").join(repeated, "id", "left_anti").distinct()).withColumnRenamed("id", "__gone")
    repeated = cut(repeated).withColumnRenamed("id", "__again")
    few = lambda rows: F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
    stay = docs.join(few(gone), F.col(key) == F.col("__gone"), "left_anti")
    if repeated.isEmpty():
        return stay
    # Rows of a repeated key are told apart by the digests of their sets.
    unique = stay.join(few(repeated), F.col(key) == F.col("__again"), "left_anti")
    again = cut(docs.join(few(repeated), F.col(key) == F.col("__again"), "left_semi"))
    digests = again.select(F.col(text).alias("__text")).distinct().mapInArrow(releasing(_digests(k)), "__text string, __d1 bigint, __d2 bigint, __n bigint")
    told = again.join(digests, again[text].eqNullSafe(digests["__text"])).drop("__text")
    goes = members.filter("goes").select(F.col("id").alias("__id"), F.col("d1").alias("__g1"), F.col("d2").alias("__g2")).distinct()
    kept = told.join(goes, (told[key] == goes["__id"]) & (told["__d1"] == goes["__g1"]) & (told["__d2"] == goes["__g2"]) & (told["__n"] > 0), "left_anti")
    empty = kept.filter("__n = 0").select(*docs.columns)
    one = kept.filter("__n > 0").groupBy(F.col(key).alias("__key"), "__d1", "__d2").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("__row")).select("__row.*")
    return unique.unionByName(empty).unionByName(one)


def _digests(k: int):
    """A function of batches of texts that gives each with the digest and size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((3, batch.num_rows), dtype=np.int64)
            for row, tokens in shingle_sets(batch.column(0), k):
                if len(tokens):
                    made[0, row], made[1, row] = fingerprint(tokens)
                    made[2, row] = len(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in made)], names=["__text", "__d1", "__d2", "__n"])

    return run
