"""N-gram Jaccard join by grouped prefixes.

Every document is its set of word shingles, put in one global order: shingles
found often come last.  Two sets of Jaccard similarity t share an element within
the first n - ceil(t n) + 1 of each, their prefixes.  Documents with the same
prefix and size form a group; a list per prefix element holds the groups, and
sizes and positions filter group pairs before members are verified.

Classes are wanted, not all pairs, so large groups of near copies never expand
into their squares.  First every list links its groups to one of them (a star);
verified links are merged into components.  Then only lists that still hold
several components are expanded to members, and only members in different
components are verified: those of short lists as pairs, those of long ones in
tiles.  A long list is dealt by bands of size and, within a band, by tiles of
bounded count and volume; a unit, one pair of tiles, is one task's work, whatever
the length of the list.  Pairs left out lie within one component, so no link
between two components is lost and the classes are exact.

Only narrow rows meet in the lists.  Texts of documents in candidate pairs go,
once per pair of blocks of documents, to the task that verifies those blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objtrail.operators.components import connected_components
from objtrail.llm.shared import ROWS_PER_FILE, Scratch, small_or_shuffled, store

WORDS = 5
PERCENT = 80
#: how many of the commonest shingles are moved to the end of the order; any
#: order gives right results, this bounds the table that every task holds
COMMON = 1 << 18
#: documents are verified in blocks of about this many shingles and documents at most
BLOCK_SHINGLES = 1_000_000
BLOCK_DOCS = 2000
#: lists up to this length are verified as pairs, longer ones in tiles of at most
#: TILE members and about TILE_SHINGLES shingles
SHORT = 32
TILE = 2000
TILE_SHINGLES = 1_000_000
#: rows of 16 bytes
BROADCAST_ROWS = 50_000
#: a list of a shingle found in so many documents is dealt over several tasks
PART_ROWS = 100_000
#: shingles held while counting, and texts turned into Python strings at a time
_COUNTED = 1_000_000
_TEXTS = 512
_BITS = 22


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct shingles of a text as a sorted array of 64-bit hashes."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and \x20 \x09-\x0D
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=n)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=n)
    last = n - words + 1
    s = np.zeros(last, dtype=np.uint64)
    for k in range(words):
        s = (s ^ (s >> np.uint64(29)) ^ h[k : k + last]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    s ^= s >> np.uint64(32)
    s.sort()
    new = np.empty(last, dtype=bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def _texts(batch: pa.RecordBatch | pa.Table, column: int | str) -> Iterator[str | None]:
    """A column's texts, some at a time."""
    values = batch.column(column)
    for at in range(0, len(values), _TEXTS):
        yield from values.slice(at, _TEXTS).to_pylist()


def required(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap with any set that a set of this size can be similar to."""
    return -(-percent * size // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles and their counts: those that recur within a stretch
    of documents, summed over all of them."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def recurring() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[some].view(np.int64)), pa.array(n[some].astype(np.int64))], schema=schema
            )

        for batch in batches:
            for text in _texts(batch, 1):
                held.append(shingles(text, words))
                size += len(held[-1])
                if size >= _COUNTED:
                    yield recurring()
                    held, size = [], 0
        if held:
            yield recurring()

    rows = (
        docs.mapInArrow(count, "token long, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(COMMON)
        .toArrow()
    )
    tokens = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("n").to_numpy()[order]


def _prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """doc_id, size, digests of the set (s1, s2) and of prefix with size (g1, g2), prefix."""
    known = docs.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "size", "s1", "s2", "g1", "g2")] + [("prefix", pa.list_(pa.int64()))]
    )

    def halves(data: bytes) -> tuple[int, int]:
        a, b = np.frombuffer(xxhash.xxh3_128_digest(data), dtype="<i8").tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = known.value
        # most shingles are not common: a table of leading bits spares them the search
        leading = np.zeros(1 << _BITS, dtype=bool)
        leading[(tokens >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        for batch in batches:
            rows, firsts = [], [np.empty(0, dtype=np.int64)]
            for text in _texts(batch, 1):
                s = shingles(text, words)
                n = len(s)
                if not n:
                    rows.append((0, 0, 0, 0, 0))
                    firsts.append(firsts[0])
                    continue
                often = np.zeros(n, dtype=np.int64)
                maybe = np.flatnonzero(leading[s >> np.uint64(64 - _BITS)])
                if len(maybe):
                    at = np.minimum(np.searchsorted(tokens, s[maybe]), len(tokens) - 1)
                    often[maybe] = np.where(tokens[at] == s[maybe], counts[at], 0)
                first = s[np.argsort(often, kind="stable")[: n - int(required(n, percent)) + 1]].view(np.int64)
                rows.append((n, *halves(s.tobytes()), *halves(first.tobytes() + n.to_bytes(8, "little"))))
                firsts.append(first)
            cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            offsets = np.cumsum([len(x) for x in firsts], dtype=np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in cols), prefix], schema=schema
            )

    out = "doc_id long, size long, s1 long, s2 long, g1 long, g2 long, prefix array<long>"
    return docs.mapInArrow(run, out)


def _dealt(entries: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Entries with the part of their list: -1, or one of several for lists of shingles found often.

    No more than ``COMMON`` shingles can have several parts, so their table is broadcast.
    """
    tokens, counts = common
    often = counts >= PART_ROWS
    if not often.any():
        return entries.withColumn("part", F.lit(-1).cast("long"))
    hot = pa.table({"token": tokens[often].view(np.int64), "parts": counts[often] // PART_ROWS + 1})
    hot = F.broadcast(entries.sparkSession.createDataFrame(hot))
    part = F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")))
    return entries.join(hot, "token", "left").withColumn("part", part.cast("long")).drop("parts")


def _within(
    size_a: np.ndarray | int, pos_a: np.ndarray | int, size_b: np.ndarray, pos_b: np.ndarray, percent: int
) -> np.ndarray:
    """Size and position filter at a shared element; a is not larger than b."""
    room = np.minimum(size_a - pos_a, size_b - pos_b)
    return (100 * size_a >= percent * size_b) & (room * (100 + percent) >= percent * (size_a + size_b))


def _stars(entries: DataFrame, percent: int) -> DataFrame:
    """Lists of two or more groups (kind 0) and their star pairs (kind 1).

    Lists are streamed: of a list that goes on in the next batch only its present
    lead is held, so a list of any length takes the memory of a batch.  A list of several
    parts makes a star of each: stars only save work, what they leave apart is found when
    lists that hold several components are opened.
    """
    names = ("kind", "token", "pos", "size", "a", "b")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def emit(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        # the lead of the last token, and whether it is yet to be listed
        carry: list[np.ndarray] | None = None
        pending = False
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5)]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            token, part, size, node, pos = cols
            n = len(token)
            starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
            length = np.diff(np.r_[starts, n])
            list_of = np.repeat(np.arange(len(starts)), length)
            # one row alone makes no list, but one part of a list may have one row
            listed = np.repeat(length > 1, length) | (part >= 0)
            listed[0] &= carry is None or pending
            rows = np.flatnonzero(listed)
            zero = np.zeros(len(rows), dtype=np.int64)
            parts.append((zero, token[rows], pos[rows], size[rows], node[rows], zero))
            # the first row of a list leads those its size admits; the first of the rest leads on
            todo = np.flatnonzero(np.repeat(length > 1, length))
            last_lead = n - 1
            while len(todo):
                first = np.r_[True, list_of[todo[1:]] != list_of[todo[:-1]]]
                lead = todo[np.maximum.accumulate(np.where(first, np.arange(len(todo)), 0))]
                inside = 100 * size[lead] >= percent * size[todo]
                pair = ~first & _within(size[lead], pos[lead], size[todo], pos[todo], percent)
                if pair.any():
                    x, y = node[lead[pair]], node[todo[pair]]
                    one, none = np.ones(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
                    parts.append((one, none, none, none, np.minimum(x, y), np.maximum(x, y)))
                if todo[-1] == n - 1 and inside[-1]:
                    last_lead = int(lead[-1])
                todo = todo[~inside]
            carry = [c[last_lead : last_lead + 1] for c in cols]
            pending = length[-1] == 1 and part[-1] < 0
            held += 2 * n
            if held > 200_000:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    # within a size, another order in each list: another group leads
    dealt = entries.select("token", "part", "size", F.xxhash64("token", "node").alias("turn"), "node", "pos")
    return (
        dealt.repartition("token", "part")
        .sortWithinPartitions("token", "part", "size", "turn", "node")
        .mapInArrow(run, ", ".join(f"{c} long" for c in names))
    )


def _open_lists(lists: DataFrame, nodes: DataFrame, count: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Members (token, pos, size, node, component, total) of lists that hold several components, and their number.

    ``lists`` has the groups of every list (token, pos, size, lead), ``nodes`` the
    members of every group with their components.  Whether a list is open is found
    on the ranges of its groups' components; only open lists are expanded.
    """
    ranges = nodes.groupBy("g1", "g2").agg(
        F.min("node").alias("lead"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.count("*").alias("n"), F.first("size").alias("size"),
    )
    ranges = scratch.store(ranges, "ranges", count)
    # a group of several sets is a list of its own
    own = ranges.where("n > 1 AND low < high").select(
        F.xxhash64("g1", "g2").alias("token"), F.lit(0).cast("long").alias("pos"), "size", "lead"
    )
    listed = lists.unionByName(own)
    span = listed.join(ranges.select("lead", "low", "high", "n"), "lead")
    several = (
        span.groupBy("token")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("total"))
        .where("low < high")
        .select("token", "total")
    )
    several = scratch.store(several, "several", lists.count())
    held = several.agg(F.sum("total").alias("n")).first().n or 0
    members = nodes.join(ranges.select("g1", "g2", "lead"), ["g1", "g2"]).select("lead", "node", "component")
    open_ = listed.join(small_or_shuffled(several, several.count(), BROADCAST_ROWS), "token")
    members = open_.join(members, "lead").select("token", "pos", "size", "node", "component", "total")
    return scratch.store(members, "open", held), held


def _short_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Filtered pairs (a, b) in different components of short lists (token, pos, size, node, component)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None

        def of(cols: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            """All lists of a batch at once: row k is paired with those 1, 2, .. rows later."""
            token, size, node, component, pos = cols
            last = np.repeat(ends, ends - starts)
            at = np.arange(starts[0], ends[-1])
            found = [np.empty((0, 2), dtype=np.int64)]
            for step in range(1, int((ends - starts).max(initial=1))):
                keep = at + step < last
                at, last = at[keep], last[keep]
                i, j = at, at + step
                ok = (component[i] != component[j]) & _within(size[i], pos[i], size[j], pos[j], percent)
                x, y = node[i[ok]], node[j[ok]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0).T
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs], schema=schema)

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            # the last list may go on in the next batch
            if len(starts) > 1:
                yield of(cols, starts[:-1], starts[1:])
            carry = [c[starts[-1] :] for c in cols]
        if carry is not None and len(carry[0]):
            yield of(carry, np.array([0]), np.array([len(carry[0])]))

    return (
        entries.select("token", "size", "node", "component", "pos")
        .repartition("token")
        .sortWithinPartitions("token", "size", "node")
        .mapInArrow(run, "a long, b long")
    )


def _units(entries: DataFrame, count: int, percent: int, scratch: Scratch) -> DataFrame:
    """Members (unit, node a, component b) of pairs of tiles of long lists that have a partner there.

    Sizes of linked sets lie in the same band or in two that follow one another.
    Band s meets itself (own) and band s + 1; unit (token, s, i, j, own) holds tiles i
    and j of band s, the others tile i of band s and j of band s + 1.
    """
    band = F.floor(F.log("size") / (np.log(100 / percent) + 1e-9)).cast("long")
    banded = entries.withColumn("band", band)
    at = ["token", "band"]
    weight = F.greatest(F.count("*") / TILE, F.sum("size") / TILE_SHINGLES)
    tiles = scratch.store(banded.groupBy(*at).agg(F.ceil(weight).cast("long").alias("tiles")), "tiles", count)
    rows = tiles.count()
    for name, step in (("above", 1), ("below", -1)):
        other = tiles.select("token", (F.col("band") - step).alias("band"), F.col("tiles").alias(name))
        tiles = tiles.join(small_or_shuffled(other, rows, BROADCAST_ROWS), at, "left")
    dealt = banded.join(small_or_shuffled(tiles, rows, BROADCAST_ROWS), at)
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))

    def partners(n: str, entry) -> F.Column:
        many = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1), entry)
        return F.filter(many, lambda _: F.col(n).isNotNull())

    def entry(s, i, j, left, right, own: bool) -> F.Column:
        unit = F.xxhash64("token", s, i, j, F.lit(own))
        return F.struct(unit.alias("unit"), left.alias("left"), right.alias("right"))

    mine, here, yes, no = F.col("tile"), F.col("band"), F.lit(True), F.lit(False)
    copies = F.concat(
        partners("tiles", lambda o: entry(here, F.least(mine, o), F.greatest(mine, o), mine <= o, mine >= o, True)),
        partners("above", lambda o: entry(here, mine, o, yes, no, False)),
        partners("below", lambda o: entry(here - 1, o, mine, no, yes, False)),
    )
    dealt = dealt.select("size", "pos", "node", "component", F.explode(copies).alias("u")).select(
        "u.*", "size", "pos", "node", "component"
    )
    found = dealt.groupBy("unit").applyInArrow(lambda t: _with_partners(t, percent), "unit long, a long, b long")
    return found.repartition(_files(count))


def _with_partners(table: pa.Table, percent: int) -> pa.Table:
    """Members of a unit that sizes and positions let link to one of another component there."""
    size, pos, node, component = (table.column(c).to_numpy() for c in ("size", "pos", "node", "component"))
    left = np.flatnonzero(table.column("left").to_numpy(zero_copy_only=False))
    right = np.flatnonzero(table.column("right").to_numpy(zero_copy_only=False))
    kept = np.zeros(len(node), dtype=bool)
    if component.min() != component.max():
        for start in range(0, len(left), 500):
            i = left[start : start + 500, None]
            small, large = np.minimum(size[i], size[right]), np.maximum(size[i], size[right])
            room = np.minimum(size[i] - pos[i], size[right] - pos[right])
            ok = (100 * small >= percent * large) & (room * (100 + percent) >= percent * (small + large))
            ok &= component[i] != component[right]
            kept[i[:, 0]] |= ok.any(axis=1)
            kept[right] |= ok.any(axis=0)
    some = np.flatnonzero(kept)
    # a member that is in the unit twice is one
    _, once = np.unique(node[some], return_index=True)
    some = some[once]
    unit = table.column("unit").to_numpy()[some]
    return pa.table({"unit": unit, "a": node[some], "b": component[some]})


def _links_of_unit(table: pa.Table, words: int, percent: int) -> pa.Table:
    """Edges between different components among a unit's documents (doc_id, b component, text)."""
    nodes = table.column("doc_id").to_numpy()
    _, group = np.unique(table.column("b").to_numpy(), return_inverse=True)
    sets = [shingles(t, words) for t in _texts(table, "text")]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    by_id = np.argsort(ids, kind="stable")
    holders = owner[by_id]
    ends = np.cumsum(np.bincount(ids))
    starts = np.r_[0, ends[:-1]]
    first = np.cumsum(size) - size
    parent = np.arange(group.max() + 1)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    largest = np.bincount(group).argmax()
    found = []
    for k in np.flatnonzero(group != largest):
        own = ids[first[k] : first[k] + size[k]]
        both = np.bincount(
            np.concatenate([holders[starts[i] : ends[i]] for i in own]), minlength=len(sets)
        )
        near = np.flatnonzero(100 * both >= percent * (size[k] + size - both))
        for m in near.tolist():
            x, y = find(group[k]), find(group[m])
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((int(nodes[k]), int(nodes[m])))
    return pa.table([pa.array([p[i] for p in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])


def _files(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_FILE))


def _verify(
    pairs: DataFrame,
    bound: int,
    units: DataFrame | None,
    sizes: DataFrame,
    docs: DataFrame,
    words: int,
    percent: int,
    scratch: Scratch,
) -> DataFrame | None:
    """Edges that connect what the similar pairs among ``pairs`` (a, b) connect, and what
    members of a unit (unit, node a, component b) link to in other components; None
    without either.

    ``pairs`` has no more than ``bound`` rows; ``sizes`` (node, size) says how much the
    texts of a pair weigh.  Documents are dealt to blocks, and pairs to pairs of blocks.
    Texts are joined once, by document, to all blocks and units that need them.
    """
    pairs = scratch.store(pairs, "pairs", bound)
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = involved.join(sizes.select("node", "size"), "node").agg(F.sum("size").alias("volume"), F.count("*").alias("n")).first()
    members = 0 if units is None else units.count()
    if not held.n and not members:
        return None
    blocks = max(1, -(-(held.volume or 0) // BLOCK_SHINGLES), -(-held.n // BLOCK_DOCS))

    def block(c: str) -> F.Column:
        return F.pmod(F.xxhash64(c), F.lit(blocks))

    cell = F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b"))
    keyed = pairs.select(F.lit(0).alias("kind"), cell.alias("key"), "a", "b")
    ends = keyed.select("kind", "key", F.col("a").alias("doc_id")).union(keyed.select("kind", "key", "b")).distinct()
    ends = ends.withColumn("b", F.lit(None).cast("long"))
    if members:
        ends = ends.unionByName(units.select(F.lit(1).alias("kind"), F.col("unit").alias("key"), F.col("a").alias("doc_id"), "b"))
    needed = scratch.store(ends, "needed", 2 * bound + members)
    # the narrow side grows with the corpus: the same plan at every size, no broadcast
    texts = docs.join(needed.hint("merge"), "doc_id").select("kind", "key", "doc_id", "b", "text")
    found = (
        keyed.groupBy("kind", "key")
        .cogroup(texts.groupBy("kind", "key"))
        .applyInArrow(
            lambda left, right: _links_of_unit(right, words, percent) if left.num_rows == 0 else _links_of_pairs(left, right, words, percent),
            "a long, b long",
        )
    )
    # a forest has fewer edges than documents; few files hold them all
    return found.repartition(_files(held.n + members))


def _files(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_FILE))


def _links_of_pairs(left: pa.Table, right: pa.Table, words: int, percent: int) -> pa.Table:
    """Edges of a block pair's pairs (a, b), given its documents (doc_id, text)."""
    sets: dict[int, list[np.ndarray]] = {}
    for name, text in zip(right.column("doc_id").to_pylist(), _texts(right, "text"), strict=True):
        sets.setdefault(name, []).append(shingles(text, words))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    found = []
    a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
    for k in np.lexsort((b, a)).tolist():
        s, t = int(a[k]), int(b[k])
        x, y = find(s), find(t)
        if x != y and any(similar(u, v, percent) for u in sets.get(s, ()) for v in sets.get(t, ())):
            parent[max(x, y)] = min(x, y)
            found.append((s, t))
    return pa.table([pa.array([p[i] for p in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])


def ngram_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    A-Z are lower-cased and words are runs of other than ASCII white space; a text
    of fewer than ``words`` words is one shingle.  Documents whose sets have a
    Jaccard similarity of ``percent`` / 100 or more are linked;
    ``component_id`` is the smallest id reachable by links, its own included.  Null
    and blank texts have no shingles and link with nothing.  Rows that repeat an
    id are one document with the links of all its texts; a row without an id
    belongs to its text's class.  An empty table gives an empty result; other
    columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch()
    common = _common_shingles(docs, words)
    prefixes = scratch.store(_prefixes(docs, common, words, percent), "prefixes")
    # a prefix has size - required(size) + 1 elements
    length = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    held = prefixes.agg(F.count("*").alias("n"), F.sum(length).cast("long").alias("entries")).first()
    count, total = held.n, held.entries or 0
    filled = prefixes.where("size > 0 AND doc_id IS NOT NULL")
    # copies of a set are one node; its smallest id stands for it
    nodes = scratch.store(
        filled.groupBy("s1", "s2").agg(
            F.min("doc_id").alias("node"), F.first("g1").alias("g1"), F.first("g2").alias("g2"), F.first("size").alias("size")
        ),
        "nodes",
        count,
    )
    groups = filled.groupBy("g1", "g2").agg(
        F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("prefix").alias("prefix")
    )
    entries = groups.select(F.posexplode("prefix").alias("pos", "token"), "size", "node").select(
        "token", F.col("pos").cast("long").alias("pos"), "size", "node"
    )
    # the last stage's tasks are bounded by the entries that come in
    lists = scratch.store(_stars(_dealt(entries, common), percent), "lists", total)
    edges = _same_id(filled, nodes)
    stars = lists.where("kind = 1").select("a", "b")
    first = _verify(stars.distinct(), stars.count(), None, nodes, docs, words, percent, scratch)
    edges = scratch.store(edges if first is None else edges.unionByName(first), "links", count)
    label = connected_components(edges, rows=edges.count())

    placed = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    listed = lists.where("kind = 0").select("token", "pos", "size", F.col("a").alias("lead"))
    left, held = _open_lists(listed, scratch.store(placed, "placed", count), count, scratch)
    short = _short_pairs(left.where(F.col("total") <= SHORT), percent).distinct()
    units = scratch.store(_units(left.where(F.col("total") > SHORT), held, percent, scratch), "units")
    more = _verify(short, held * SHORT, units, nodes, docs, words, percent, scratch)
    if more is not None:
        edges = scratch.store(edges.unionByName(more), "links", count)
        label = connected_components(edges, rows=edges.count())

    of_node = nodes.select("s1", "s2", "node").join(label, "node", "left").select(
        "s1", "s2", F.coalesce("component", "node").alias("component")
    )
    # all that the result reads: narrow rows
    of_node = store(of_node, "classes", count)
    sets = store(prefixes.select("doc_id", "size", "s1", "s2"), "sets", count)
    scratch.drop()
    joined = sets.join(of_node, ["s1", "s2"], "left")
    own = F.when(F.col("size") > 0, F.col("component"))
    return joined.select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce(own, F.col("doc_id")).alias("component_id")
    )


def one_of_each_class(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` of which one of each class stays, in all their columns.

    Rows are decided one by one, whether they have an id of their own or not: of each
    class the row with the smallest id stays (null ids come last), and of rows that
    repeat that id one.  Rows without words are classes of their own.
    """
    scratch = Scratch()
    numbered = store(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    count = numbered.count()
    classes = ngram_classes(numbered, "_row", text_col, words, percent).select("doc_id", "component_id")
    classes = classes.withColumnsRenamed({"doc_id": "_row", "component_id": "_class"})
    # most rows are alone in their class
    several = classes.where("_row <> _class").select("_class").distinct()
    members = scratch.store(classes.join(several, "_class"), "members", count)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("_row"))
    first = numbered.select("_row", id_col).join(members, "_row").groupBy("_class").agg(F.min(order)["_row"].alias("_row"))
    gone = store(members.select("_row").join(first.select("_row"), "_row", "left_anti"), "gone", count)
    scratch.drop()
    return numbered.join(gone, "_row", "left_anti").drop("_row")


def _same_id(filled: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that join the sets of rows that repeat an id."""
    again = filled.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    sets = filled.select("doc_id", "s1", "s2").join(again, "doc_id").join(nodes.select("s1", "s2", "node"), ["s1", "s2"])
    # an id's sets all hold it, so their nodes are all linked to the smallest of them
    sets = sets.select("doc_id", "node").distinct()
    low = sets.groupBy("doc_id").agg(F.min("node").alias("low"))
    return sets.join(low, "doc_id").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
