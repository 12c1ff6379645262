"""N-gram Jaccard join by a token-group matrix: components of documents whose sets of 5-word
shingles have a Jaccard similarity of 0.75 or more.

Words are lower-cased in A-Z; a text of fewer than five words is one shingle, a text without words has
none and links with nothing; null counts as empty. Shingles are 64-bit hashes. Documents with the
same set are one vertex, so copies cost nothing.

1. All shingles get one order: by hash, but the most frequent ones (at most HOT of them, found by
   counting every document's shingles) last. Sets with similarity t share one of the first
   n - ceil(t n) + 1 in that order: their prefix.
2. Similar documents form groups. At each token of several prefixes the vertex with the least id leads, and
   a vertex goes with the leader that it shares most tokens with, if they can be similar or are KIN at
   least; leaders go with others in turn. Where over CROWD groups would meet at a token, those that share enough such tokens become
   one: copies of one text that are far from each other are compared there, and don't meet as groups of one each. Groups of more
   than GROUP tokens are split into blocks, between what went with one leader where that is small. A block is one task's work: it holds its members' sets as an index from the tokens of their union to members,
   counts overlaps there, and joins what is similar. Leaders are held against the blocks of their followers.
3. The matrix holds, for each token of a prefix, the groups that have it in a prefix, by class of size, with the
   least and greatest size, place and component. A vertex is a query to the groups of other components at its
   tokens, and there to the classes of similar size; of two groups the larger one is asked. Two similar sets share r tokens among the first that are
   one more than either may miss of the other, and r - 1 more. So only tokens that stand there count, the others meet nothing,
   and where r are found the query comes to the group once, with its whole set, and the classes that are asked with
   theirs. There its overlap with their whole union is a closer bound; only groups that qualify are opened, and overlaps with their
   members are counted.

Every similar pair shares a prefix token. It is in one group and is compared there, or its groups meet at
that token, or it is in one component already: no link between different components is lost. All
decisions are made on the whole sets; no pair but the links between components leaves a task.

Repeated rows, and rows with a null doc_id, are documents of their own; a component of nulls only has a
null id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import UnionFind, WordHashes, components, drop, join_checked, join_on_hot, map_arrow, ngrams, parallelism, slices, stage

K = 5
#: Most frequent shingles that stand last in the order, and tokens in a block of a group.
HOT, GROUP = 1 << 18, 1 << 21
#: Shingles that are counted at once, and the least count there that is passed on.
COUNTED, LEAST = 1 << 21, 4
#: A frequent token's rows are dealt out in so many parts if it has over a SALT_SHARE-th of all rows.
SALTS, SALT_SHARE = 64, 20
#: A vertex goes with a leader that can't be similar, too, if they share over a KIN-th of its size in prefixes: so do many
#: that are alike but not similar, and few tokens of theirs then lie in several groups.
KIN = 16
#: Families that may meet at a token. Where there are more, those become one of which a vertex shares over an ALIKE-th of
#: its size at such tokens; texts that share a passage or a shingle by chance stay apart.
CROWD, ALIKE = 16, 128
#: Sizes are of one class if they are as long in binary and begin with the same CLASS digits: a group of short and long texts has
#: no bound on what a query must share with it, so whatever shares a shingle with it by chance would come to it.
CLASS = 5
#: Sets that Python gets at once.
BATCH = 2000
#: Queries that a group answers at once.
ASKED = 64
TOP = np.uint64(1 << 62)

_hash = WordHashes()


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode().lower().split()
    return np.unique(ngrams(_hash.of(words), min(K, len(words)))) if words else np.zeros(0, np.uint64)


def vertex(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def ordered(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set's tokens in the order of all: 62 bits of the hash, or above them a frequent one's rank."""
    if not len(hot):
        return s >> np.uint64(2)
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    return np.concatenate([s[~is_hot] >> np.uint64(2), np.sort(TOP + rank[at[is_hot]])])


def _views(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [flat[i - at[0] : j - at[0]] for i, j in zip(at[:-1], at[1:], strict=True)]


def enough(n: str, low: str, high: str, c: str) -> str:
    """Whether a set of n can be similar to one of low to high, of whose prefix it shares c tokens at most in its own.
    Of the set whose prefix ends first, all other tokens of the prefix are missing from the other set."""
    return f"(4 * {high} >= 3 * {n} and 4 * {n} >= 3 * {low} and (7 * ({n} - floor((3 * {n} + 3) / 4) + 1 - {c}) <= 4 * {n} - 3 * {low} or 28 * {c} >= 12 * {n} - 9 * {high} + 7))"


def more(n: str, least: str, most: str) -> str:
    """How many tokens beyond the first one a set of n must share with a similar set of least to most: two fifths of
    those that their prefixes allow for. Near copies that went with no leader share under a KIN-th of their size in prefixes; if
    they are as large as each other, these tokens stand too late to count, so that they don't all meet each other."""
    return f"(greatest(0, least(12L * {least} - 9L * {n}, 12L * {n} - 9L * {most}) - 21) div 70)"


def reaches(place: str, n: str, low: str) -> str:
    """Whether a token at a place of a set of n can count for any set of low or more."""
    m = f"greatest(4L * {low}, 3L * {n})"
    return f"280L * {place} <= 160L * {n} - 30L * {m} + greatest(0, least(12L * {m} - 36L * {n}, 48L * {n} - 9L * {m}))"


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """doc_id, n, v, tokens: a set comes once a task, with its first document."""
    seen: set[int] = set()
    for b in slices(batches):
        sizes, vertices, sets = [], [], []
        for t in b.column(1).to_pylist():
            s = shingles(t or "")
            v = vertex(s)
            sizes.append(len(s))
            vertices.append(v)
            sets.append(None if not len(s) or v in seen else s.view(np.int64))
            seen.add(v)
        if len(seen) > 1_000_000:
            seen.clear()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(vertices, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "n", "v", "tokens"])


def _frequent(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= LEAST
        return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep])], ["token", "n"])

    for b in slices(batches):
        held.append(b.column(0).flatten().to_numpy().view(np.uint64))
        size += len(held[-1])
        if size > COUNTED:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def _prefixes(batches: Iterable[pa.RecordBatch], hot: np.ndarray, rank: np.ndarray) -> Iterable[pa.RecordBatch]:
    """token, v, n, pos of every prefix."""
    for b in slices(batches):
        v, sets = b.column(0).to_numpy(), _views(b.column(1))
        n = np.array([len(s) for s in sets])
        size = n - (3 * n + 3) // 4 + 1
        flat = [ordered(s, hot, rank)[:k] for s, k in zip(sets, size, strict=True)]
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(flat).view(np.int64)), pa.array(np.repeat(v, size)), pa.array(np.repeat(n, size).astype(np.int32)), pa.array(pos.astype(np.int32))],
            ["token", "v", "n", "pos"],
        )


def _shared(batches: Iterable[pa.RecordBatch], salted: int) -> Iterable[pa.RecordBatch]:
    """Of rows sorted by (token, salt, v) those whose token has several vertices, once each, with the first
    vertex at their token. Rows from the token `salted` on stay in any case: others may be in another task."""
    names = ["token", "v", "n", "pos", "a", "m", "at"]
    held: list[np.ndarray] | None = None  # the last row and the first of its token; it is decided when its successor is known
    joined = False
    for b in batches:
        if not b.num_rows:
            continue
        c = [x.to_numpy() for x in b.columns]
        if held is not None:
            c = [np.append(x, y) for x, y in zip(held[:5], c, strict=True)]
        key = (c[0][1:] != c[0][:-1]) | (c[4][1:] != c[4][:-1])
        new = np.append(True, key | (c[1][1:] != c[1][:-1]))
        c = [x[new] for x in c]
        same = (c[0][1:] == c[0][:-1]) & (c[4][1:] == c[4][:-1])
        begins = np.append(True, ~same)
        first = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
        lead = [c[1][first], c[2][first], c[3][first]]
        if held is not None:  # rows of the token that goes on have the leader from before
            goes_on = first == 0
            lead = [np.where(goes_on, h, x) for h, x in zip(held[5:], lead, strict=True)]
        before = np.append(joined, same)
        out = before[:-1] | same | (c[0][:-1] >= salted)
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][out]) for x in [*c[:4], *lead]], names)
        held, joined = [x[-1:] for x in [*c, *lead]], bool(before[-1])
    if held is not None and (joined or held[0][0] >= salted):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in [*held[:4], *held[5:]]], names)


class Group:
    """The sets of a group: from the tokens of their union to the members that hold them."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        by = np.argsort(flat, kind="stable")
        flat, self.member = flat[by], member[by]
        begins = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        self.union, self.begins, self.ends = flat[begins], begins, np.append(begins[1:], len(flat))
        # tokens of many members are columns of a matrix: at most four times as many as a mean set has
        self.column = np.full(len(begins), -1)
        often = np.flatnonzero((self.ends - self.begins) * 4 > len(sets)) if len(sets) > 16 else np.zeros(0, int)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(sets), len(often)), np.float32)
        at, length = self.places(often)
        self.dense[self.member[at], np.repeat(np.arange(len(often)), length)] = 1.0

    def places(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the members of some tokens stand, and how many there are of each."""
        length = self.ends[tokens] - self.begins[tokens]
        return np.repeat(self.begins[tokens] - (np.cumsum(length) - length), length) + np.arange(length.sum()), length

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Which tokens of the union a set holds; their number bounds its overlap with every member."""
        at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
        return at[self.union[at] == s]

    def similar(self, sizes: np.ndarray, hits: list[np.ndarray]) -> np.ndarray:
        """For each query (its size and hits), which members are similar."""
        overlap = np.zeros((len(hits), len(self.n)), np.int64)
        columns = np.zeros((len(hits), self.dense.shape[1]), np.float32)
        for i, h in enumerate(hits):
            c = self.column[h]
            columns[i, c[c >= 0]] = 1.0
            overlap[i] = np.bincount(self.member[self.places(h[c < 0])[0]], minlength=len(self.n))
        if columns.size:
            overlap += np.rint(columns @ self.dense.T).astype(np.int64)
        return 7 * overlap >= 3 * (sizes[:, None] + self.n[None, :])

    def ask(self, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(query, the members similar to it) of the queries that the group is opened for."""
        hits = [self.hits(s) for s in sets]
        least = self.n.min()
        opened = [i for i, (s, h) in enumerate(zip(sets, hits, strict=True)) if 7 * len(h) >= 3 * (len(s) + least)]
        for at in range(0, len(opened), ASKED):
            some = opened[at : at + ASKED]
            found = self.similar(np.array([len(sets[i]) for i in some]), [hits[i] for i in some])
            for i, row in zip(some, found, strict=True):
                if row.any():
                    yield i, np.flatnonzero(row)

    def joined(self, sets: list[np.ndarray]) -> np.ndarray:
        """Each member's component: the place of its first member. Who is in the first one's component when
        its turn comes asks nothing, as all that it could join with it there are in it already."""
        links = UnionFind()
        todo, at = np.ones(len(sets), bool), 0
        while todo.any():
            some = np.flatnonzero(todo)[: 1 if at == 0 else ASKED]
            todo[some], at = False, at + 1
            for i, members in self.ask([sets[i] for i in some]):
                for m in members.tolist():
                    links.join(int(some[i]), m)
            main = links.find(0)
            for x in np.flatnonzero(todo).tolist():
                todo[x] = links.find(x) != main
        return np.array([links.find(i) for i in range(len(sets))])


def groups_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]]]:
    """Of rows (h, query, v, c, tokens) sorted by (h, query, v): each group's members, and its queries in parts.
    A vertex that comes more than once counts once."""

    def runs() -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, list[np.ndarray]]]:
        last = None
        for b in slices(batches, 256):
            h, query, v, c = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sets = _views(b.column(4))
            keys = list(zip(h.tolist(), query.tolist(), v.tolist(), strict=True))
            keep = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]
            last = keys[-1] if keys else last
            i = 0
            while i < len(keep):
                j = i
                while j < len(keep) and keys[keep[j]][:2] == keys[keep[i]][:2]:
                    j += 1
                at = keep[i:j]
                yield *keys[at[0]][:2], v[at], c[at], [sets[x].copy() for x in at]
                i = j

    source = runs()
    ahead = next(source, None)
    while ahead is not None:
        h, vs, cs, sets = ahead[0], [], [], []
        while ahead is not None and ahead[0] == h and not ahead[1]:
            vs.append(ahead[2])
            cs.append(ahead[3])
            sets += ahead[4]
            ahead = next(source, None)

        def queries(h: int = h) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == h:
                now, ahead = ahead, next(source, None)
                yield now[2], now[3], now[4]

        asked = queries()
        if sets:
            yield np.concatenate(vs), np.concatenate(cs), sets, asked
        for _ in asked:
            pass


def _inside(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """v, c, link: the component of every member within its group, and components that queries link with."""
    for v, _, sets, queries in groups_of(batches):
        group = Group(sets)
        c = v[group.joined(sets)]
        out = [(v, c, np.zeros(len(v), bool))]
        for asking, _, asked in queries:
            for i, members in group.ask(asked):
                to = np.unique(c[members])
                out.append((np.full(len(to), asking[i]), to, np.ones(len(to), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["v", "c", "link"])


def _across(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """a, b: components that a query links."""
    for _, c, sets, queries in groups_of(batches):
        group, found = Group(sets), set()
        for _, own, asked in queries:
            for i, members in group.ask(asked):
                found |= {(int(own[i]), x) for x in np.unique(c[members]).tolist() if x != own[i]}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


class Matrix:
    """The token-group matrix of a table of documents."""

    def __init__(self, docs: DataFrame):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.parts = parallelism(docs.sparkSession)
        self.rows = stage(map_arrow(docs, _sets, "doc_id long, n int, v long, tokens array<long>"), "jaccard", "snappy")  # hashes don't compress
        self.sets = self.rows.where("tokens is not null").select("v", "tokens")
        shared, salted = self._shared()
        self.shared = self.led = stage(shared, "jaccard", batch=BATCH)
        self.salted = salted
        if salted is not None:  # such a token has a leader in each of its parts: the least of them leads; at most HOT rows
            parted = self.shared.where(F.col("token") >= salted)
            heads = parted.groupBy("token").agg(F.min(F.struct("a", "m", "at")).alias("head"))
            led = parted.join(F.broadcast(heads), "token").select("token", "v", "n", "pos", "head.a", "head.m", "head.at")
            self.led = self.shared.where(F.col("token") < salted).unionByName(led)
        self.members = stage(self._members(), "jaccard")

    def _shared(self) -> tuple[DataFrame, int | None]:
        """What stands at tokens of several prefixes, and from which token on rows were salted."""
        counts = map_arrow(self.sets.select("tokens"), _frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        counts = stage(counts, "jaccard", batch=BATCH)
        # the least count of which at most HOT tokens have as much; counts in steps of an eighth of a power of two
        step, least, held = F.floor(8 * F.log2("n")), 0, 0
        for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("tokens"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"]):
            if held + r["tokens"] > HOT:
                break
            held, least = held + r["tokens"], r["least"]
        frequent = counts.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("token", "ascending")]) if held else None  # at most HOT rows
        hot, n = (frequent[c].to_numpy() if held else np.zeros(0, np.int64) for c in ("token", "n"))
        drop(counts)
        hot, rank = hot.view(np.uint64), np.arange(len(hot), 0, -1).astype(np.uint64)  # the most frequent last
        by = np.argsort(hot)
        bar = max(self.rows.count() // SALT_SHARE, 1)
        salted = int(TOP) + len(hot) + 1 - int((n > bar).sum())
        tokens = map_arrow(self.sets, _prefixes, "token long, v long, n int, pos int", hot=hot[by], rank=rank[by])
        tokens = tokens.withColumn("salt", F.when(F.col("token") >= salted, F.pmod("v", F.lit(SALTS))).otherwise(0).cast("int"))
        tokens = tokens.repartition(self.parts, "token", "salt").sortWithinPartitions("token", "salt", "v")
        shared = map_arrow(tokens, _shared, "token long, v long, n int, pos int, a long, m int, at int", salted=salted)
        return shared, salted if (n > bar).any() else None

    def _members(self) -> DataFrame:
        """v, n, a, label, g, size, smallest, largest: every vertex that shares a token, with its leader and its group (a block of those of
        one label), and how many vertices of which sizes the label has."""
        # c: how many tokens of their prefixes v and a share; pos, at: where the last one stands, what stands before it without being common is missing from the other set
        met = self.led.groupBy("v", "a").agg(F.count("*").alias("c"), F.max("pos").alias("pos"), F.max("at").alias("at"), F.first("n").alias("n"), F.first("m").alias("m"))
        may = f"v <> a and (7 * least(n - (pos + 1 - c), m - (at + 1 - c)) >= 3 * (n + m) and {enough('n', 'm', 'm', 'c')} or {KIN} * c > n)"
        best = met.groupBy("v").agg(F.first("n").alias("n"), F.max(F.when(F.expr(may), F.struct("c", F.bitwise_not("a").alias("a")))).alias("best"))
        best = stage(best.select("v", "n", F.bitwise_not("best.a").alias("a")), "jaccard")
        trees = components(best.where("a is not null"), "v", "a").withColumnRenamed("id", "v")
        members = stage(best.join(trees, "v", "left").select("v", "n", F.coalesce("component", "v").alias("family"), "a"), "jaccard")
        members = join_checked(members, self._merged(members), "family", "left").withColumn("label", F.coalesce("label", "family"))
        # a label's blocks hold whole families, but for large ones, of which there are few
        large = members.groupBy("family").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > GROUP // 8).select("family", F.lit(True).alias("large"))
        members = stage(members.join(F.broadcast(large), "family", "left").withColumn("kept", F.when(F.col("large"), F.col("v")).otherwise(F.col("family"))).drop("family", "large"), "jaccard")
        sizes = members.groupBy("label").agg(F.sum("n").alias("tokens"), F.count("*").alias("size"), F.min("n").alias("smallest"), F.max("n").alias("largest")).withColumn("__n", F.col("size"))
        members = join_on_hot(members, stage(sizes, "jaccard"), ["label"], "__n", "inner")
        block = F.pmod(F.xxhash64("kept"), F.ceil(F.col("tokens") / GROUP))
        return members.select("v", "n", "a", "label", F.xxhash64("label", block).alias("g"), "size", "smallest", "largest")

    def _merged(self, members: DataFrame) -> DataFrame:
        """family, label: which families (what went with one leader) become one, as over CROWD of them meet at tokens that they share."""
        crowds = self.shared.groupBy("token").agg(F.count("*").alias("rows"), F.min("n").alias("lowest")).where(F.col("rows") > CROWD)
        crowds = stage(crowds.select("token", "lowest"), "jaccard")
        at = join_checked(self.shared.select("token", "v", "n", "pos"), crowds, "token").where(reaches("pos", "n", "lowest"))
        at = stage(at.select("token", "v", "n").join(members.select("v", "family"), "v"), "jaccard")
        first = at.select("token", "family").distinct().groupBy("token").agg(F.count("*").alias("families"), F.min("family").alias("first")).where(F.col("families") > CROWD)
        met = join_checked(at, stage(first.select("token", "first"), "jaccard"), "token").groupBy("v", "first").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("family").alias("family"))
        merged = components(met.where(F.col("c") * ALIKE > F.col("n")), "family", "first")
        drop(crowds, at)
        return merged.withColumnRenamed("id", "family").withColumnRenamed("component", "label")

    def _open(self, rows: DataFrame, f, schema: str) -> DataFrame:
        """f over groups: rows (h, query, v, c) with the sets."""
        rows = join_checked(self.sets, rows, "v").select("h", "query", "v", "c", "tokens")
        return map_arrow(rows.repartition(self.parts, "h").sortWithinPartitions("h", "query", "v"), f, schema)

    def inside(self) -> tuple[DataFrame, DataFrame]:
        """(v, c): the components within groups; (a, b): links between these components, through the leaders."""
        several = self.members.where("size > 1")
        asking = several.where("a is not null").select(F.col("g").alias("h"), F.lit(True).alias("query"), F.col("a").alias("v")).distinct()
        asking = asking.join(several.select(F.col("g").alias("h"), "v"), ["h", "v"], "left_anti").select("h", "query", "v")  # it is in that block itself
        rows = several.select(F.col("g").alias("h"), F.lit(False).alias("query"), "v").union(asking).withColumn("c", F.col("v"))
        found = stage(self._open(stage(rows, "jaccard"), _inside, "v long, c long, link boolean"), "jaccard", batch=BATCH)
        own = found.where("not link").select("v", "c")
        links = found.where("link").select("v", F.col("c").alias("b")).join(own, "v", "left")
        return own, stage(links.select(F.coalesce("c", "v").alias("a"), "b").where("a <> b").distinct(), "jaccard")

    def _mixed(self, at: DataFrame) -> DataFrame:
        """at's rows at tokens where several groups and components meet, with the least size there: dealt out by token
        once. Tokens of much of all rows are summed up first, and as there are few of them, the sums are broadcast."""
        known = {"g0": F.min("g"), "g1": F.max("g"), "c0": F.min("c"), "c1": F.max("c"), "lowest": F.min("n")}
        rows = at if self.salted is None else at.where(F.col("token") < self.salted)
        rows = rows.withColumns({k: f.over(Window.partitionBy("token")) for k, f in known.items()})
        if self.salted is not None:
            crowded = at.where(F.col("token") >= self.salted)
            sums = crowded.groupBy("token").agg(*[f.alias(k) for k, f in known.items()])
            rows = rows.unionByName(crowded.join(F.broadcast(sums), "token"))
        return rows.where("g0 <> g1 and c0 <> c1")

    def across(self, placed: DataFrame) -> DataFrame:
        """(a, b): links between components. placed holds v, n, g, size, smallest, largest, c."""
        shift = f"greatest(length(bin(n)) - {CLASS}, 0)"
        placed = placed.withColumn("s", F.expr(f"shiftleft(shiftright(n, {shift}), {shift})"))
        placed = placed.select("v", "n", "g", "size", F.greatest("smallest", "s").alias("s0"), F.least("largest", F.expr(f"s + shiftleft(1, {shift}) - 1")).alias("s1"), "c")
        at = self._mixed(self.shared.select("token", "v", "pos").join(placed, "v")).where(reaches("pos", "n", "lowest"))
        # a group's rows at a token lie in one task already, so that they are summed up without a shuffle; the row of the least v has the group's figures
        cell = Window.partitionBy("token", "g", "s0")
        sums = {"low": F.min("n"), "high": F.max("n"), "least": F.min("pos"), "c0": F.min("c"), "c1": F.max("c"), "v0": F.min("v")}
        at = at.select("token", "v", "n", "pos", "g", "size", "s0", "s1", "c").withColumns({k: f.over(cell) for k, f in sums.items()})
        at = stage(at.withColumn("stands", F.col("v") == F.col("v0")).drop("v0"), "jaccard")
        groups = at.where("stands").select("token", F.col("g").alias("h"), "s0", "s1", "low", "high", "least", "c0", "c1", F.col("size").alias("k"))
        asking = at.select("token", "v", "n", "pos", "g", "size", "c")
        beyond = more("n", "s0", "s1")
        met = asking.join(groups, "token").where(f"(k > size or k = size and h > g) and (c0 <> c or c1 <> c) and 4 * high >= 3 * n and 4 * n >= 3 * low and 7 * (pos - {beyond}) <= 4 * n - 3 * low and 7 * (least - {beyond}) <= 4 * high - 3 * n")
        # the first of the common tokens must leave enough behind it, and there must be enough of them
        first = F.expr("4 * n - 7 * pos >= 3 * low and 4 * high - 7 * least >= 3 * n")
        met = met.groupBy("h", "s0", "v").agg(F.first("c").alias("c"), F.count("*").alias("common"), F.first(F.expr(beyond)).alias("beyond"), F.max(first).alias("first"))
        met = stage(met.where("first and common > beyond").select("h", "s0", "v", "c"), "jaccard")
        holding = placed.select(F.col("g").alias("h"), "s0", "v", "c").join(met.select("h", "s0").distinct(), ["h", "s0"], "left_semi")
        rows = stage(holding.select("h", F.lit(False).alias("query"), "v", "c").unionByName(met.select("h", F.lit(True).alias("query"), "v", "c").distinct()), "jaccard")
        links = stage(self._open(rows, _across, "a long, b long").distinct(), "jaccard", batch=BATCH)
        drop(at, met, rows)
        return links


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    matrix = Matrix(docs)
    own, links = matrix.inside()
    first = components(links)
    placed = matrix.members.select("v", "n", "g", "size", "smallest", "largest").join(own, "v", "left").withColumn("c", F.coalesce("c", "v"))
    placed = stage(join_checked(placed, first.withColumnRenamed("id", "c"), "c", "left").withColumn("c", F.coalesce("component", "c")).drop("component"), "jaccard")
    found = components(matrix.across(placed))
    found = join_checked(placed.select("v", "c"), found.withColumnRenamed("id", "c"), "c", "left").select("v", F.coalesce("component", "c").alias("component"))
    rows = stage(matrix.rows.select("doc_id", "n", "v"), "jaccard")
    classes = rows.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    classes = stage(classes.join(found, "v", "left").withColumn("component", F.coalesce("component", "v")), "jaccard")
    drop(matrix.rows, matrix.shared, matrix.members, placed, own)
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("rows").alias("all"))
    ids = join_on_hot(classes, least.withColumn("__n", F.col("all")), ["component"], "__n", "inner").where("all > 1").select("v", "component_id", "rows")
    out = join_on_hot(rows, stage(ids, "jaccard"), ["v"], "rows")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs' rows, one document of each component: that with the smallest doc_id."""
    stays = similar_documents(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stays, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left_semi")
