"""Exact join of documents whose sets of word n-grams have a Jaccard similarity of at least num/den.

Size-aware heavy-light join. Light (small) sets are joined by equality of enumerated subsets of a
fixed size, which needs no verification: sets of sizes a and b link exactly if they share
ceil(num (a + b) / (num + den)) elements. Heavy sets scan inverted lists of the first elements of
their sets, rarest first (two sets that link share one of them). The boundary is where the counted
cost of both is least.

A list is not expanded into pairs of rows. Inside a task its sets are compared by size and by the
Hamming distance of 256-bit parity vectors, which is at most the size of the symmetric difference,
and only a spanning forest of what passes goes out. The forests' components hold every link;
inside each the sets themselves are compared by scanning their inverted lists, and again a forest
of the true links goes out. Long lists and large components are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.llm.common import components, drop, fresh, mix, prepare, sliced, summed, text_buffer, tidy, word_hashes, written

#: Counters of the frequency sketch that orders elements; slices it is summed in.
SKETCH, SLICES = 1 << 22, 16
#: Sets of a list, and elements of a component, that one task compares at a time.
LIST_BLOCK, GROUP_ELEMENTS = 2048, 2_000_000
#: Edges that a task remembers so as not to repeat them.
SEEN_EDGES = 300_000
#: Largest size that subsets may be enumerated for, and the most subsets of one set.
LIGHT_MOST, SUBSETS_MOST = 40, 4096
#: Sets above LARGE elements have EXTRA (of den) of their elements as additional entries: see extra_entries.
LARGE, EXTRA = 800, 3
#: Lists that may be longer than this (by the sketch) are counted by partial sums and looked up in so many salts.
LONG_LIST, SALTS = 50_000, 64
#: Cost of a list entry against one enumerated subset: it is shuffled, and compared in its list.
LIST_COST = 4


def shared_needed(a, b, num: int, den: int):
    """Least intersection of sets of sizes a and b that link: inter/union >= num/den."""
    return -(-num * (a + b) // (num + den))


def extra_entries(n):
    """Entries l of a set of size n beyond its first list entry, plus one.

    If the first n - ceil(t n) + l elements of two sets that link are looked at, they share l of
    them. So a large set, fewer of whose entries than that are met in any other set, links with
    nothing: it is dropped before lists are compared, where its parity vector would tell little.
    """
    return np.where(n > LARGE, -(-EXTRA * n // 100), 1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted within each, and where each text's begin."""
    h, first = word_hashes(raw, offsets)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    grams, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= words:
        total = h[: len(h) - words + 1].copy()
        for k in range(1, words):
            total = mix(total * np.uint64(3)) + h[k : len(h) - words + 1 + k]
        inside = doc[words - 1 :] == doc[: len(h) - words + 1]
        grams, of = mix(total[inside]), doc[: len(h) - words + 1][inside]
    few = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(few):
        whole = np.array([int(np.bitwise_xor.reduce(mix(h[first[d] : first[d + 1]] + np.arange(1, n_words[d] + 1, dtype=np.uint64)))) for d in few], np.uint64)
        grams, of = np.concatenate((grams, mix(whole + np.uint64(7)))), np.concatenate((of, few))
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(len(n_words) + 1))


def parity(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """256 bits for each set: how many elements fall on a bit, modulo two."""
    n = len(first) - 1
    bit = (grams & np.uint64(255)).astype(np.int64)
    of = np.repeat(np.arange(n), np.diff(first))
    odd = np.bincount(of * 256 + bit, minlength=n * 256)[: n * 256].reshape(n, 256) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[first[1:]] - total[first[:-1]]


def describe(docs: DataFrame, text: str, key: str, words: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, n, parity) of every row, a rarity class for every slot of the sketch, and which slots may have long lists."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slots = np.zeros(SKETCH, np.int64), [np.zeros(0, np.uint32)]
        names = ["id", "n", "parity", "slice", "blob"]
        for batch in batches:
            grams, first = shingle_sets(*text_buffer(batch.column(1)), words)
            slots.append((grams >> np.uint64(42)).astype(np.uint32))
            if sum(map(len, slots)) > SKETCH // 4:
                total += np.bincount(np.concatenate(slots), minlength=SKETCH)
                slots = []
            n, none = batch.num_rows, pa.nulls(batch.num_rows, pa.int64())
            bits = pa.array([x.tobytes() for x in parity(grams, first)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), bits, none, pa.nulls(n, pa.binary())], names=names)
        total += np.bincount(np.concatenate([*slots, np.zeros(0, np.uint32)]), minlength=SKETCH)
        part = sliced(total, SLICES)
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), *part.columns], names=names)

    out = written(rows.mapInArrow(tidy(run), "id long, n long, parity binary, slice long, blob binary"), "jaccard-sets")
    counts = summed(out.where("slice is not null").select("slice", "blob"), SKETCH)
    rarity = np.minimum(255, np.floor(8 * np.log2(1 + counts))).astype(np.uint8)
    return out.where("slice is null").select("id", "n", "parity"), rarity, counts > LONG_LIST


def subsets_of(n: int, most: int, num: int, den: int) -> list[tuple[int, int]]:
    """(partner size, subset size) for every size up to most that can link with n."""
    sizes = range(max(1, -(-num * n // den)), min(most, n * den // num) + 1)
    return [(b, int(shared_needed(n, b, num, den))) for b in sizes]


def boundary(info: DataFrame, num: int, den: int) -> int:
    """Largest light size: where subsets enumerated plus list entries cost least over all sets."""
    counts = {r["n"]: r["c"] for r in info.where(F.col("n").between(1, 2 * LIGHT_MOST)).groupBy("n").agg(F.count("*").alias("c")).collect()}

    def cost(most: int) -> int:
        light = sum(c * sum(comb(n, s) for _, s in subsets_of(n, most, num, den)) for n, c in counts.items() if n <= most)
        heavy = sum(c * LIST_COST * (n - -(-num * n // den) + 1) for n, c in counts.items() if n * den >= num * (most + 1))
        return light + heavy

    fits = [m for m in range(LIGHT_MOST + 1) if all(comb(m, s) <= SUBSETS_MOST for _, s in subsets_of(m, m + 9, num, den))]
    return min(fits, key=lambda m: (cost(m), m))


def entries(docs: DataFrame, text: str, key: str, words: int, rarity: np.ndarray, hot: np.ndarray, most: int, num: int, den: int) -> DataFrame:
    """Rows (kind, k1, k2, id): 0 list entry (k1 element), 5 additional entry, 1/2/3 subset (equal sizes, smaller side, larger side), 4 same set as k1 in the task.

    k2 of an entry is 1 if its list may be long.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id is not null")

    def subsets(set_: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        a, b = mix(set_ + np.uint64(1)), mix(set_ ^ np.uint64(0x94D049BB133111EB))
        ta, tb = a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)
        for other, size in subsets_of(n, most, num, den):
            pair = mix(np.array([min(n, other) * 1_000_003 + max(n, other)], np.uint64))
            left_out = np.array(list(combinations(range(n), n - size)), np.int64).reshape(comb(n, size), n - size)
            ka = mix(ta - a[left_out].sum(axis=1, dtype=np.uint64) + pair)
            kb = mix(tb - b[left_out].sum(axis=1, dtype=np.uint64) + pair)
            kind = 1 if other == n else 2 if n < other else 3
            for x, y in zip(ka.view(np.int64).tolist(), kb.view(np.int64).tolist()):
                yield kind, x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            grams, first = shingle_sets(*text_buffer(batch.column(1)), words)
            n = np.diff(first)
            sa, sb = _sums(mix(grams), first).tolist(), _sums(mix(grams ^ np.uint64(0x5DEECE66D)), first).tolist()
            kinds, k1, k2, own = [], [], [], []
            fresh = np.zeros(len(n), bool)
            for d in np.flatnonzero(n).tolist():
                known = seen.setdefault((sa[d], sb[d], int(n[d])), int(ids[d]))
                if known != ids[d]:
                    kinds.append(4), k1.append(known), k2.append(0), own.append(int(ids[d]))
                    continue
                fresh[d] = True
                if n[d] <= most:
                    for kind, x, y in subsets(grams[first[d] : first[d + 1]], int(n[d])):
                        kinds.append(kind), k1.append(x), k2.append(y), own.append(int(ids[d]))
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((grams, rarity[(grams >> np.uint64(42)).astype(np.int64)], of))
            rank = np.arange(len(grams)) - np.repeat(first[:-1], n)
            heavy = fresh & (n * den >= num * (most + 1))
            length = n - -(-num * n // den) + 1
            use = heavy[of] & (rank < (length + extra_entries(n) - 1)[of])
            g, o, more = grams[order][use], of[use], (rank >= length[of])[use]
            columns = [
                pa.array(np.concatenate((np.array(kinds, np.int64), np.where(more, 5, 0)))),
                pa.array(np.concatenate((np.array(k1, np.int64), g.view(np.int64)))),
                pa.array(np.concatenate((np.array(k2, np.int64), hot[(g >> np.uint64(42)).astype(np.int64)].astype(np.int64)))),
                pa.array(np.concatenate((np.array(own, np.int64), ids[o]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "k1", "k2", "id"])

    return written(rows.mapInArrow(tidy(run), "kind long, k1 long, k2 long, id long"), "jaccard-entries")


def _forest(count: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of 0..count-1; near(k) gives a mask of what k is next to."""
    left, edges = np.ones(count, bool), []
    for root in range(count):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            k = todo.pop()
            found = np.flatnonzero(near(k) & left)
            left[found] = False
            edges += [(root, int(x)) for x in found]
            todo += found.tolist()
            if not left.any():
                return edges
    return edges


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of equal keys ends; rows come sorted by the keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            before = rest[-1].column(k)[-1].as_py() if rest else v[0]
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(rest) and before != v[0]
        last = np.flatnonzero(change)
        if len(last):
            cut = int(last[-1])
            done = pa.Table.from_batches([*rest, batch.slice(0, cut)])
            if len(done):
                yield done
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _edge_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def list_edges(lists: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a spanning forest, list by list, of sets near enough to be compared in full."""
    from pyspark.sql import Window

    usual = lists.where("k2 = 0").withColumn("c", F.count("*").over(Window.partitionBy("k1"))).where("c > 1")
    long = lists.where("k2 = 1").withColumn("salt", F.expr(f"pmod(xxhash64(id), {SALTS})"))
    sizes = long.groupBy("k1").agg(F.count("*").alias("c")).where("c > 1").withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    many = written(usual.select("kind", "k1", "id", "c").unionAll(long.join(sizes, ["k1", "salt"]).select("kind", "k1", "id", "c")), "jaccard-lists")
    least = F.ceil(F.lit(num) * F.col("n") / den)
    needed = F.when(least > LARGE, F.ceil(F.lit(EXTRA) * least / 100)).otherwise(1)
    able = many.groupBy("id").agg(F.count("*").alias("met")).join(info.where("n > 0").dropDuplicates(["id"]), "id").where(F.col("met") >= needed)
    many = many.where("kind = 0").join(able, "id")
    blocks = F.expr(f"cast(ceil(c / {LIST_BLOCK}) as int)")
    many = many.withColumn("nb", blocks).withColumn("blk", F.expr("pmod(xxhash64(id), nb)"))
    dealt = many.select("k1", "id", "n", "parity", "blk", F.explode(F.expr("sequence(0, nb - 1)")).alias("o"))
    dealt = dealt.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("blk", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def unseen(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            if len(seen) > SEEN_EDGES:
                seen.clear()
            new = [p for p in pairs if p not in seen]
            seen.update(new)
            return _edge_batch([a for a, _ in new], [b for _, b in new])

        for table in _whole_groups(batches, ["k1", "i", "j"]):
            ids, n = table["id"].to_numpy(), table["n"].to_numpy()
            bits = np.frombuffer(b"".join(table["parity"].to_pylist()), "<u8").reshape(-1, 4)
            k, i, j = (table[c].to_numpy() for c in ("k1", "i", "j"))
            new = np.ones(len(ids), bool)
            new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(ids)))
            group = np.repeat(np.arange(len(start)), size)

            def near(x, y):
                total = n[x] + n[y]
                far = total - 2 * shared_needed(total, 0, num, den)
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=-1)
                return (np.minimum(n[x], n[y]) * den >= num * np.maximum(n[x], n[y])) & (apart <= far)

            small = size[group] <= 8
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, 8):
                x = np.flatnonzero(small[:-d] & (group[d:] == group[:-d])) if len(group) > d else np.zeros(0, np.int64)
                x = x[near(x, x + d)]
                a.append(ids[x]), b.append(ids[x + d])
            pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
            yield unseen([tuple(p) for p in pairs.tolist()])
            for g in np.flatnonzero(size > 8):
                s, c = int(start[g]), int(size[g])
                everyone = np.arange(s, s + c)
                edges = _forest(c, lambda x: near(np.array([s + x]), everyone))
                yield unseen([(int(ids[s + x]), int(ids[s + y])) for x, y in edges])

    together = dealt.repartition("k1", "i", "j").sortWithinPartitions("k1", "i", "j", "id")
    near = written(together.mapInArrow(tidy(run), "a long, b long"), "jaccard-near")
    drop(many)
    return near


def set_edges(docs: DataFrame, text: str, key: str, words: int, groups: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a spanning forest of the true links inside each group (node, component)."""
    sizes = groups.join(info.dropDuplicates(["id"]), F.col("node") == F.col("id")).groupBy("component").agg(F.sum("n").alias("s"))
    placed = groups.join(sizes, "component").withColumn("nb", F.expr(f"cast(ceil(s / {GROUP_ELEMENTS}) as int)"))
    placed = placed.withColumn("blk", F.expr("pmod(xxhash64(node), nb)"))
    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("t")).where("node is not null").join(placed, "node")
    dealt = rows.select("component", "node", "t", "blk", F.explode(F.expr("sequence(0, nb - 1)")).alias("o"))
    dealt = dealt.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).select("component", "i", "j", "node", "t")

    def compare(group: pa.Table) -> pa.Table:
        ids = group["node"].to_numpy()
        grams, first = shingle_sets(*text_buffer(group["t"]), words)
        n = np.diff(first)
        of = np.repeat(np.arange(len(n)), n)
        _, token = np.unique(grams, return_inverse=True)
        order = np.argsort(token, kind="stable")
        begin = np.searchsorted(token[order], np.arange(token.max() + 2 if len(token) else 1))
        lists = of[order]

        def near(k: int) -> np.ndarray:
            t = token[first[k] : first[k + 1]]
            count = begin[t + 1] - begin[t]
            at = np.repeat(begin[t] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            shared = np.bincount(lists[at], minlength=len(n))
            return (shared > 0) & (den * shared >= num * (n + n[k] - shared))

        edges = _forest(len(n), near)
        return pa.table({"a": pa.array([ids[x] for x, _ in edges], pa.int64()), "b": pa.array([ids[y] for _, y in edges], pa.int64())})

    return dealt.groupBy("component", "i", "j").applyInArrow(compare, "a long, b long")


def subset_edges(subsets: DataFrame) -> DataFrame:
    """(a, b): sets that share a subset, as stars; the sides of unequal sizes link only across."""
    first = subsets.groupBy("k1", "k2").agg(
        F.min(F.expr("if(kind = 3, null, id)")).alias("left"), F.min(F.expr("if(kind = 3, id, null)")).alias("right"), F.count("*").alias("c")
    )
    first = first.where("c > 1").select("k1", "k2", "left", "right")
    own = subsets.join(first, ["k1", "k2"])
    return own.select(F.col("id").alias("a"), F.expr("case kind when 1 then left when 2 then right else left end").alias("b")).where("b is not null")


def links(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(id, n, parity) of every row, and (a, b): linked documents, enough of them to connect all that link."""
    prepare(docs.sparkSession)
    info, rarity, hot = describe(docs, text, key, words)
    most = boundary(info, num, den)
    found = entries(docs, text, key, words, rarity, hot, most, num, den)
    near = list_edges(found.where("kind in (0, 5)"), info, num, den)
    groups = components(near, "jaccard-groups")
    drop(near)
    full = set_edges(docs, text, key, words, groups, info, num, den)
    same = found.where("kind = 4").selectExpr("k1 a", "id b")
    return info, full.unionAll(subset_edges(found.where("kind in (1, 2, 3)"))).unionAll(same)


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document row: key, n_shingles, component_id (smallest id reachable by links).

    Words are lower-cased in A-Z; a text of fewer words than the n-gram has its whole sequence as
    only element, a text without words none, and such a text links with nothing. Ids are whole
    numbers and stand for one text: rows that repeat an id with the same text are one document;
    under an id with several texts the links of one of them, at least, are found. A null id has no
    links and a null component. An empty table gives no rows; other columns are ignored.
    """
    info, edges = links(docs, text, key, words, num, den)
    reached = components(edges, "jaccard-links")
    out = info.join(reached, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """The documents without those whose group has a smaller id, with all their columns.

    key holds whole numbers. Null ids and texts without words stay; rows that repeat the kept id stay as
    often as they are there. An empty table gives no rows.
    """
    _, edges = links(docs, text, key, words, num, den)
    gone = fresh(docs.columns, "gone")[0]
    smaller = components(edges, "jaccard-links").where("node <> component").select(F.col("node").alias(gone))
    return docs.join(smaller, docs[key].cast("long") == F.col(gone), "left_anti")
