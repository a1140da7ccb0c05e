"""N-gram Jaccard self-join with token-combination prefixes (operator 10).

A document's set holds its distinct 5-word shingles. Documents link when
``100 * |x & y| >= 75 * |x | y|``; the result is the connected component of each.

For a set of n tokens any partner shares at least ``o = ceil(t * n)`` of them, so
at most ``tau = n - o`` stay unshared, and among the first ``tau + 1`` tokens in
any global order one is shared. The order used puts tokens of one document first,
then rare ones (in at most ``rare`` sets), then frequent ones.

1. Token postings are counted in hash buckets. A document with more than ``tau``
   tokens of its own can have no partner and leaves at once. Equal sets collapse
   to their smallest id, and the rest is counted once more.
2. Within the prefix each rare token is indexed alone. Where the prefix reaches
   frequent tokens it is extended by ``tau / 2 + 1`` of them, and combinations of
   two frequent tokens at most three places apart are indexed: of the shared
   tokens some neighbouring pair then has at most two unshared tokens between
   them, in both documents together, so a linking pair shares an indexed key.
3. Keys held by few documents give all their pairs, other keys a star around
   their smallest document. Candidates are verified on whole sets.
4. Where a star still holds several components, its documents outside the
   leader's component meet all others: as listed pairs in a small star, in a
   large one as blocks of bounded size without a row for each pair. So every two
   documents that share a key are compared, or already in one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billforge.llm.shared import components, cut, one_text
from billforge.llm.text import U64, mix, shingles, slices

WINDOW = 3  # places between combined tokens; see step 2
_CHUNK = "bucket int, kind byte, base long, docs binary, a binary, b binary"
_CHUNK_PA = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("base", pa.int64()), ("docs", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
_MOST_BITS = 30
_RARE, _META, _FREQUENT, _HEAVY = 0, 1, 2, 3


def _overlap(n: np.ndarray | int, percent: int):
    return (percent * n + 99) // 100


def _pack_docs(docs: np.ndarray) -> tuple[int, bytes]:
    base = int(docs.min()) if len(docs) else 0
    offset = (docs - base).astype(U64)
    most = int(offset.max()) if len(docs) else 0
    kind = np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else U64
    return base, offset.astype(kind).tobytes()


def _unpack_docs(base: int, data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    kind = {2: np.uint16, 4: np.uint32, 8: U64}[len(data) // n]
    return (np.frombuffer(data, kind).astype(U64) + U64(base % (1 << 64))).astype(np.int64)


def _by_bucket(buckets: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets.astype(np.uint16 if size <= 1 << 16 else np.uint32), kind="stable")
    sorted_ = buckets[order]
    cuts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1], True]) if len(order) else np.zeros(0, np.int64)
    for begin, end in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        yield int(sorted_[begin]), order[begin:end]


def _doc_bucket(docs: np.ndarray, size: int) -> np.ndarray:
    return (mix(docs.astype(U64)) % U64(size)).astype(np.int64)


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNK_PA, strict=True)], schema=_CHUNK_PA)


def _emit(docs: np.ndarray, sets: list[np.ndarray], n: np.ndarray, keys: list[bytes], bits: int, most: int, rare: int) -> Iterator[pa.RecordBatch]:
    """Packed postings of the documents' tokens, and their sizes and set keys.

    A token that more than ``rare`` documents of a chunk hold is frequent for sure:
    its documents are told at once and only its count is sent to its bucket, so
    that a token of very many documents doesn't fill a bucket.
    """
    size, cut_off = 1 << bits, max(0, 16 - bits)
    rows = []
    for b, at in _by_bucket(_doc_bucket(docs, size), size):
        rows.append((size + b, _META, 0, docs[at].tobytes(), n[at].tobytes(), b"".join(keys[i] for i in at)))
    yield _chunks(rows)
    lens = np.array([len(s) for s in sets], np.int64)
    begin = 0
    while begin < len(sets):  # postings of a bounded number of tokens at a time
        end = max(begin + 1, int(np.searchsorted(np.cumsum(lens[begin:]), most, "right")) + begin)
        tokens = np.concatenate(sets[begin:end])
        if len(tokens):
            order = np.argsort(tokens)
            tokens, owner = tokens[order], np.repeat(docs[begin:end], lens[begin:end])[order]
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            held = np.diff(np.r_[first, len(tokens)])
            heavy = held > rare
            rows = []
            if heavy.any():
                all_of = np.repeat(heavy, held)
                rows += list(_hits(owner[all_of], (tokens[all_of] >> U64(cut_off)) << U64(cut_off), _FREQUENT, size, size))
                rows += _postings(tokens[first[heavy]], bits, lambda at: (_HEAVY, 0, held[heavy][at].astype(np.int64).tobytes()))
                tokens, owner = tokens[~all_of], owner[~all_of]
            rows += _postings(tokens, bits, lambda at: (_RARE, *_pack_docs(owner[at])))
            yield _chunks(rows)
        begin = end


def _postings(tokens: np.ndarray, bits: int, docs) -> list[tuple]:
    """Rows of the buckets of sorted tokens; ``docs`` gives kind, base and documents of a slice."""
    buckets = (tokens >> U64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True]).tolist() if len(tokens) else []
    out = []
    for begin, end in zip(cuts, cuts[1:], strict=False):
        rest = (tokens[begin:end] << U64(bits)) >> U64(16)
        out.append((int(buckets[begin]), *docs(slice(begin, end)), rest.astype(np.uint32).tobytes(), (rest >> U64(32)).astype(np.uint16).tobytes()))
    return out


def _whole(rest: np.ndarray, bucket: int, bits: int) -> np.ndarray:
    """Tokens from their bucket and the 48 bits after it; with fewer than 16 bucket bits the last ones are zero."""
    low = rest << U64(16 - bits) if bits <= 16 else rest >> U64(bits - 16)
    return (U64(bucket) << U64(64 - bits)) | low


def _hits(docs: np.ndarray, tokens: np.ndarray, kind: int, size: int, shift: int) -> Iterator[tuple]:
    """Rows that tell buckets of documents their tokens of a kind."""
    for b, at in _by_bucket(_doc_bucket(docs, size), size) if len(docs) else ():
        at = at[np.argsort(docs[at], kind="stable")]
        base, packed = _pack_docs(docs[at])
        yield (shift + b, kind, base, packed, tokens[at].tobytes(), None)


def _token_groups(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """Tokens and documents of postings, and counts added up of tokens that are frequent in a chunk."""
    tokens, docs, heavy, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for row in rows:
        low = np.frombuffer(row["a"], np.uint32)
        own = (np.frombuffer(row["b"], np.uint16).astype(U64) << U64(32)) | low
        if row["kind"] == _HEAVY:
            heavy.append(own)
            counts.append(np.frombuffer(row["docs"], np.int64))
        else:
            tokens.append(own)
            docs.append(_unpack_docs(row["base"], row["docs"], len(low)))
    known, at = np.unique(np.concatenate(heavy), return_inverse=True)
    return np.concatenate(tokens), np.concatenate(docs), known, np.bincount(at, np.concatenate(counts), minlength=len(known))


def _count(bits: int, rare: int):
    """Per bucket: the tokens that more than one document holds, sent on to buckets of documents."""
    size = 1 << bits

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= size:
            out = [(bucket - size, r["kind"], r["base"], r["docs"], r["a"], r["b"]) for r in table.to_pylist()]
            return pa.Table.from_batches([_chunks(out)])
        tokens, docs, heavy, counts = _token_groups(table.to_pylist())
        order = np.argsort(tokens, kind="stable")
        tokens, docs = tokens[order], docs[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
        own = np.diff(np.r_[first, len(tokens)])
        total = own.copy()
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, tokens[first]), len(heavy) - 1)
            total += np.where(heavy[at] == tokens[first], counts[at], 0).astype(np.int64)
        held = np.repeat(total, own)
        rows: list[tuple] = []
        for kind, keep in ((_RARE, (held > 1) & (held <= rare)), (_FREQUENT, held > rare)):
            rows += _hits(docs[keep], _whole(tokens[keep], bucket, bits), kind, size, 0)
        return pa.Table.from_batches([_chunks(rows)] if rows else [], _CHUNK_PA)

    return run


_DOC = "doc_id long, n long, key binary, rare binary, frequent binary"
_DOC_PA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("rare", pa.binary()), ("frequent", pa.binary())])


def _gather(percent: int):
    """Per bucket of documents: each one's shared tokens, or nulls where it can have no partner."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        meta: dict[int, tuple[int, bytes]] = {}
        parts: dict[int, tuple[list, list]] = {_RARE: ([], []), _FREQUENT: ([], [])}
        for row in table.to_pylist():
            if row["kind"] == _META:
                keys = row["b"]
                for i, (d, n) in enumerate(zip(np.frombuffer(row["docs"], np.int64).tolist(), np.frombuffer(row["a"], np.int64).tolist(), strict=True)):
                    meta[d] = max(meta.get(d, (0, b"")), (n, keys[16 * i : 16 * i + 16]))
            else:
                tok = np.frombuffer(row["a"], U64)
                parts[row["kind"]][0].append(_unpack_docs(row["base"], row["docs"], len(tok)))
                parts[row["kind"]][1].append(tok)
        ids = np.array(sorted(meta), np.int64)
        spans = {}
        for kind, (docs, tokens) in parts.items():
            d = np.concatenate([np.zeros(0, np.int64), *docs])
            t = np.concatenate([np.zeros(0, U64), *tokens])
            order = np.lexsort((t, d))
            d, t = d[order], t[order]
            if len(d):
                keep = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]
                d, t = d[keep], t[keep]
            spans[kind] = (t, np.searchsorted(d, ids), np.searchsorted(d, ids, "right"))
        out: list[tuple] = []
        for i, d in enumerate(ids.tolist()):
            n, set_key = meta[d]
            rare, frequent = (t[a[i] : b[i]] for t, a, b in (spans[_RARE], spans[_FREQUENT]))
            own = n - len(rare) - len(frequent)
            if n == 0 or own > n - _overlap(n, percent):
                out.append((d, n, set_key, None, None))
            else:
                out.append((d, n, set_key, rare.tobytes(), frequent.tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DOC_PA, strict=True)] if out else [pa.array([], f.type) for f in _DOC_PA], schema=_DOC_PA)

    return run


def _shared_tokens(chunks: DataFrame, bits: int, rare: int, percent: int) -> DataFrame:
    hits = chunks.groupBy("bucket").applyInArrow(_count(bits, rare), _CHUNK)
    return hits.groupBy("bucket").applyInArrow(_gather(percent), _DOC)


def _keys(percent: int):
    """The index keys of each document: rare tokens of its prefix, or also combinations of frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, docs, sizes = [], [], []
            for d, n, r, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "rare", "frequent")), strict=True):
                rare, frequent = np.frombuffer(r, U64), np.frombuffer(f, U64)
                tau = n - int(_overlap(n, percent))
                need = tau + 1 - (n - len(rare) - len(frequent))
                own = [rare[:need]]
                if need > len(rare):
                    more = frequent[: need - len(rare) + (tau + 1) // 2 + 1]
                    own += [mix(more[:-g] * U64(0xD6E8FEB86659FD93) + more[g:]) for g in range(1, WINDOW + 1) if len(more) > g]
                own = np.unique(np.concatenate(own))
                keys.append(own)
                docs.append(np.full(len(own), d, np.int64))
                sizes.append(np.full(len(own), n, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in keys], docs, sizes)], names=["k", "doc", "n"])

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = [], []
            for x, y, n, m, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "s_a", "s_b")), strict=True):
                common = _common(np.frombuffer(s, U64), np.frombuffer(t, U64))
                if 100 * common >= percent * (n + m - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Numbers of common tokens of every left with every right set, by products of incidence matrices."""
    sizes = [len(x) for x in [*left, *right]]
    every = np.concatenate([np.zeros(0, U64), *left, *right])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, code, held = np.unique(every, return_inverse=True, return_counts=True)
    shared = held[code] > 1
    code, owner = code[shared], owner[shared]
    _, code = np.unique(code, return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for begin in range(0, int(code.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(code, [begin, begin + columns])
        there = np.zeros((len(sizes), columns), np.float32)
        there[owner[a:b], code[a:b] - begin] = 1
        out += there[: len(left)] @ there[len(left) :].T
    return out


def _verify_block(percent: int):
    """Links between the documents of one block that are outside the leader's component and all others.

    Of a document's links to one component, one is enough.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.select(["side", "doc", "n", "component", "s"]).to_pylist()
        left, right = ([r for r in rows if r["side"] == k] for k in (0, 1))
        a, b = [], []
        if left and right:
            common = _overlaps(*([np.frombuffer(r["s"], U64) for r in side] for side in (left, right)))
            n, m = (np.array([r["n"] for r in side], np.int64) for side in (left, right))
            of_x, of_y = (np.array([r["component"] for r in side], np.int64) for side in (left, right))
            linked = (100 * common >= percent * (n[:, None] + m[None] - common)) & (of_x[:, None] != of_y[None])
            x, y = np.nonzero(linked)
            _, first = np.unique(np.stack([x, of_y[y]]), axis=1, return_index=True)
            a, b = [left[i]["doc"] for i in x[first]], [right[i]["doc"] for i in y[first]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links(sets: DataFrame, percent: int, pairs_up_to: int, list_up_to: int, block: int) -> DataFrame:
    """node, component of the linked documents among distinct sets (doc_id, n, rare, frequent)."""
    keys = cut(sets.mapInArrow(_keys(percent), "k long, doc long, n long"))
    groups = keys.groupBy("k").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("held"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("sum")).where("held > 1")
    #: of keys with the same documents one is enough
    groups = groups.groupBy("leader", "held", "sum").agg(F.min("k").alias("k")).select("k", "leader", "held")
    held = cut(keys.join(groups, "k"))
    few = held.where(F.col("held") <= pairs_up_to).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("doc", "n"))).alias("g"))
    few = few.select(F.explode(F.expr("flatten(transform(g, (x, i) -> transform(slice(g, i + 2, size(g)), y -> struct(x.doc as a, x.n as n_a, y.doc as b, y.n as n_b))))")).alias("p")).select("p.*")
    #: one star for all keys with one leader: two documents of a key are both in its leader's star
    many = cut(held.where(F.col("held") > pairs_up_to).select("leader", "doc", "n").distinct())
    leaders = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"))
    star = many.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b"), F.col("n").alias("n_b")).join(leaders, "a")
    near = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    pairs = cut(few.unionByName(star).where(near).distinct())
    tokens = sets.select(F.col("doc_id").alias("doc"), F.concat("rare", "frequent").alias("s"))
    of_a, of_b = (tokens.select(F.col("doc").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(of_a, "a").join(of_b, "b").mapInArrow(_verify(percent), "a long, b long")

    edges = cut(verified(pairs))
    found = cut(components(edges))
    #: stars that still hold several components
    named = many.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    lead = found.select(F.col("node").alias("leader"), F.col("component").alias("led"))
    named = named.join(lead, "leader", "left").withColumn("led", F.coalesce("led", "leader")).select("leader", "doc", "n", "component", (F.col("component") != F.col("led")).alias("out"))
    open_stars = named.groupBy("leader").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("out").cast("long")).alias("outside")).where("outside > 0")
    todo = cut(named.join(open_stars, "leader"))
    #: few documents: the pairs across components; many: blocks of documents
    small = todo.where(F.col("all") <= list_up_to).groupBy("leader").agg(F.sort_array(F.collect_list(F.struct("doc", "n", "component", "out"))).alias("g"))
    small = small.select(F.explode(F.expr("flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, size(g)), y -> y.component <> x.component and (x.out or y.out)), y -> struct(x.doc as a, x.n as n_a, y.doc as b, y.n as n_b))))")).alias("p"))
    rest = cut(small.select("p.*").where(near).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    edges = edges.union(verified(rest))
    todo = todo.where(F.col("all") > list_up_to)
    left_of = F.ceil(F.col("outside") / block).cast("int")
    right_of = F.ceil(F.col("all") / block).cast("int")
    todo = todo.withColumn("lb", F.pmod(F.xxhash64("doc"), left_of).cast("int")).withColumn("rb", F.pmod(F.xxhash64(F.lit(1), "doc"), right_of).cast("int"))
    left = todo.where("out").withColumn("rb", F.explode(F.sequence(F.lit(0), right_of - 1))).withColumn("side", F.lit(0))
    right = todo.withColumn("lb", F.explode(F.sequence(F.lit(0), left_of - 1))).withColumn("side", F.lit(1))
    cols = ["leader", "lb", "rb", "side", "doc", "n", "component"]
    met = cut(left.select(cols).union(right.select(cols)))
    if met.isEmpty() and rest.isEmpty():
        return found
    late = met.join(tokens, "doc").groupBy("leader", "lb", "rb").applyInArrow(_verify_block(percent), "a long, b long")
    return components(edges.union(late))


def link_components(docs: DataFrame, *, percent: int = 75, shingle: int = 5, rare: int = 8, pairs_up_to: int = 8, list_up_to: int = 64, block: int = 512, bucket_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id of ``docs`` (doc_id long, text string; other columns are ignored).

    Rows that repeat a doc_id with one text count once, and of different texts with
    one doc_id that of the least hash stands for it (shared.one_text). Null, empty and blank
    texts have no shingles and link with nothing; rows without a doc_id are left
    out. An empty table gives an empty result. ``bucket_tokens`` bounds the
    postings in one counting task, ``pairs_up_to`` the keys whose pairs are
    listed, ``list_up_to`` the stars whose remaining pairs are listed, and ``block``
    the documents of each side that meet in one verification task of other stars.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    docs = one_text(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(_MOST_BITS, max(4, int(np.ceil(np.log2(max(1, size / 6 / bucket_tokens))))))

    def from_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1000):
            sets = [np.unique(s) for s in shingles(part.column("text"), shingle)]
            ids = part.column("doc_id").to_numpy()
            n = np.array([len(s) for s in sets], np.int64)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield from _emit(ids, sets, n, keys, bits, bucket_tokens, rare)

    def from_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.sort(np.concatenate([np.frombuffer(x, U64) for x in p])) for p in zip(part.column("rare").to_pylist(), part.column("frequent").to_pylist(), strict=True)]
            yield from _emit(part.column("doc_id").to_numpy(), sets, part.column("n").to_numpy(), part.column("key").to_pylist(), bits, bucket_tokens, rare)

    every = cut(_shared_tokens(docs.mapInArrow(from_text, _CHUNK), bits, rare, percent))
    able = every.where("rare is not null")
    same = able.groupBy("key").agg(F.min("doc_id").alias("rep"))
    member = cut(able.select("doc_id", "key").join(same, "key").select("doc_id", "rep"))
    reps = able.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = cut(_shared_tokens(reps.mapInArrow(from_sets, _CHUNK), bits, rare, percent).where("rare is not null"))
    linked = _links(sets, percent, pairs_up_to, list_up_to, block)
    named = member.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("doc_id", F.coalesce("component", "rep").alias("c"))
    return every.select("doc_id", "n").join(named, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
