"""Jaccard join of word n-gram sets by universe partition and pigeonhole.

Sets.  A document is the set of hashes of its distinct five-word shingles.
Documents with equal sets are one node, named by their smallest identifier.

Signatures.  Size bands span a factor of four.  In a band all hashes are dealt
to a fixed number of segments.  Two sets of n and l elements with enough in
common differ in H = floor((n + l) / 7) elements at most (for 0.75), so of any
H + 1 segments one is untouched.  A set indexes its first H + 1 non-empty
segments in one order that all sets share: the first segment in that order
that a similar pair has in common is among the first H + 1 of both.  The order
is by cost: segments made of frequent hashes only come last, larger segments
come before smaller ones.  A set with too few non-empty segments for that also
indexes its first H + 1 single hashes; a pair can miss the segments only if
both sets are short, and then both have them.  A set that may have a partner
in the next band is indexed there too.  One-deletion neighbourhoods are left
out: one side would have to index every element of every segment, several
times the signatures (figures in the README).

Frequent hashes are counted over all documents: each task reports hashes it
has met several times, and a histogram of the sums by powers of two gives the
count from which they are few enough to broadcast.  They steer the order only;
no pair depends on them.

Verification.  First every set is compared with one centre: of the sets that
meet most others, the one it shares most signatures with.  Confirmed pairs give
components.  Then the groups that still hold several components are compared
in blocks, across components only, after size and a parity sketch (a lower
bound of the difference) have ruled out what they can.  Each pair left is
verified on whole texts.  Links inside a component that is known already are
not sought: the result is the component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.tables import BROADCAST_ROWS, shared_if_small, stored

WORDS = 5
NUM, DEN = 75, 100  # similarity: DEN * intersection >= NUM * union
SEGMENTS_PER_ELEMENT = 0.5  # of the largest set of a band
HOT_LOCAL = 3  # occurrences in a chunk before a task reports a hash
HOT = 100  # documents from which a hash counts as frequent
HOT_KEPT = 1 << 20  # frequent hashes that steer the order at most: 8 MB
CHUNK = 4_000_000  # hashes counted at a time
BLOCK = 256
LEAST_BITS = 128  # of a sketch
PAIRS_AT_ONCE = 100_000
STAR = 64  # members verified against one copy of their centre
KEPT_BYTES = 32 << 20  # of words per Python worker, by estimate
LONGEST_KEPT = 1024  # longer words are hashed each time

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PLACES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))


class Words(dict):
    """Word -> 64-bit hash, for the words seen last."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST_KEPT:
            self.held += 180 + len(word)
            if self.held > KEPT_BYTES:
                self.clear()
                self.held = 180 + len(word)
            self[word] = value
        return value


def shingles(text: str | None, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; shorter texts are one shingle, no words are none."""
    words = (text or "").encode(errors="replace").lower().split()  # bytes: A-Z and ASCII white space only
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        span = min(WORDS, len(h))
        out = h[: len(h) - span + 1] * _PLACES[0]
        for k in range(1, span):
            out += h[k : len(h) - span + 1 + k] * _PLACES[k]
        out = mix(out + np.uint64(span))
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_names(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the elements per bit: two sketches differ in as many bits as the sets in elements at most.

    A set of n has the first power of two from n bits; the larger of two is
    folded to the size of the smaller.
    """
    size = max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A sketch as words, folded to ``size`` bytes."""
    whole = np.frombuffer(bits, np.uint64)
    return np.bitwise_xor.reduce(whole.reshape(-1, size // 8), axis=0) if len(bits) > size else whole


def plausible(bits: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows the sketches do not rule out."""
    size = np.array([len(b) for b in bits])
    least = np.minimum(size[i], size[j])
    near = np.zeros(len(i), bool)
    for s in np.unique(least):
        own = np.flatnonzero(least == s)
        used, place = np.unique(np.concatenate((i[own], j[own])), return_inverse=True)
        words = np.stack([folded(bits[k], s) for k in used])
        a, b = place[: len(own)], place[len(own) :]
        for at in range(0, len(own), PAIRS_AT_ONCE):
            part = slice(at, at + PAIRS_AT_ONCE)
            apart = np.bitwise_count(words[a[part]] ^ words[b[part]]).sum(axis=1, dtype=np.int64)
            near[own[part]] = apart <= most_apart(n[i[own[part]]], n[j[own[part]]])
    return near


def most_apart(n, other):
    """Largest symmetric difference of similar sets with n and other elements."""
    # intersection >= NUM (n + other) / (NUM + DEN)
    return (n + other) * (DEN - NUM) // (DEN + NUM)


class Hot:
    """Frequent hashes with a quick filter."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def flags(self, tokens: np.ndarray) -> np.ndarray:
        flags = self.filter[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)]
        maybe = np.flatnonzero(flags)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, tokens[maybe]), len(self.hashes) - 1)
            flags[maybe] = self.hashes[at] == tokens[maybe]
        return flags


def signatures(tokens: np.ndarray, hot: Hot) -> np.ndarray:
    """All signatures of a set, of its own band and, where it may have partners there, of the next."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    band = (n.bit_length() - 1) // 2
    top = 4 ** (band + 1) - 1
    largest = n * DEN // NUM
    out = [_band_signatures(tokens, hot, band, most_apart(n, min(largest, top)))]
    if largest > top:
        out.append(_band_signatures(tokens, hot, band + 1, most_apart(n, largest)))
    return np.concatenate(out)


def _least(cost: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least costs, in any order."""
    return np.argpartition(cost, k - 1)[:k] if k < len(cost) else np.arange(len(cost))


def _band_signatures(tokens: np.ndarray, hot: Hot, band: int, apart: int) -> np.ndarray:
    segments = max(1, int(SEGMENTS_PER_ELEMENT * 4 ** (band + 1)))
    segment = ((tokens >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)  # grows with the hash
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    scattered = mix(tokens)
    frequent = hot.flags(tokens)
    with np.errstate(over="ignore"):
        content = np.add.reduceat(scattered, starts)
        size = np.diff(np.append(starts, len(tokens)))
        all_hot = np.add.reduceat(frequent.astype(np.int64), starts) == size
        # One number per segment orders by cost: frequent last, larger first, then by place.
        cost = (all_hot.astype(np.uint64) << np.uint64(63)) | ((np.uint64(255) - np.minimum(size, 255).astype(np.uint64)) << np.uint64(48)) | segment[starts]
        picked = _least(cost, apart + 1)
        named = mix(content[picked] ^ mix(segment[starts][picked] + np.uint64((band + 1) << 40)))
        if len(starts) <= apart:  # too few segments for the pigeonhole: go on with single elements
            single = _least((tokens >> np.uint64(1)) | (frequent.astype(np.uint64) << np.uint64(63)), apart + 1)
            named = np.concatenate((named, mix(scattered[single] + np.uint64((band + 1) << 50))))
    return named


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's names, size and sketch; per task the hashes met several times."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("chk", pa.int64()), ("sketch", pa.binary()), ("hash", pa.int64()), ("met", pa.int64())])
    known, seen, held, size = Words(), set(), [], 0

    def counts() -> pa.RecordBatch:
        hashes, met = np.unique(np.concatenate(held), return_counts=True)
        often = met >= HOT_LOCAL
        k = int(often.sum())
        nothing = [pa.nulls(k, f.type) for f in schema][:5]
        return pa.record_batch([*nothing, pa.array(hashes[often].view(np.int64)), pa.array(met[often])], schema=schema)

    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            tokens = shingles(text, known)
            names = set_names(tokens) if len(tokens) else (None, None)
            rows.append((doc_id, len(tokens), *names, sketch(tokens) if len(tokens) else None))
            if len(tokens) and names not in seen:
                seen.add(names)
                held.append(tokens)
                size += len(tokens)
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.record_batch([*(pa.array(c, f.type) for c, f in zip(columns, list(schema)[:5], strict=True)), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], schema=schema)
        if size >= CHUNK:
            yield counts()
            held, size = [], 0
    if held:
        yield counts()


def _sign(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, hot = Words(), set(), shared.value
        for batch in batches:
            out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for text in batch.column("text").to_pylist():
                tokens = shingles(text, known)
                if not len(tokens):
                    continue
                sid = set_names(tokens)[0]
                if sid in seen:  # a copy in this task adds nothing
                    continue
                seen.add(sid)
                out.append(signatures(tokens, hot))
                owner.append(np.full(len(out[-1]), sid, np.int64))
            yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner))], names=["sig", "sid"])

    return run


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, sid): each set once per signature, signatures with one set left out."""
    last: tuple[int, int] | None = None  # sig and sid of the last row
    waiting = False  # the last row began its run and has not been given out
    for batch in batches:
        sig, sid = batch.column("sig").to_numpy(), batch.column("sid").to_numpy()
        if not len(sig):
            continue
        if last is not None:
            sig, sid = np.concatenate(([last[0]], sig)), np.concatenate(([last[1]], sid))
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])))
        sig, sid = sig[fresh], sid[fresh]
        start = np.concatenate(([True], sig[1:] != sig[:-1]))
        more = np.append(~start[1:], False)  # another set of the same signature follows
        out = ~start | more
        if last is not None:  # the first row is the carried one
            start[0] = waiting
            out[0] = waiting and more[0]
        if out.any():
            yield pa.record_batch([pa.array(sig[out]), pa.array(sid[out])], names=["sig", "sid"])
        last, waiting = (int(sig[-1]), int(sid[-1])), bool(start[-1])


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, length) of each run of equal signatures."""
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    return first, np.diff(np.append(first, len(sig)))


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many other sets each set meets, per batch."""
    for batch in batches:
        if batch.num_rows:
            _, size = _runs(batch.column("sig").to_numpy())
            yield pa.record_batch([batch.column("sid"), pa.array(np.repeat(size - 1, size))], names=["sid", "met"])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set of a signature with the one of them that meets most others.

    A signature cut by the end of a batch has two centres, which is no loss:
    centres are proposals only.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, sid, met = (batch.column(c).to_numpy() for c in ("sig", "sid", "met"))
        first, size = _runs(sig)
        run = np.repeat(np.arange(len(first)), size)
        order = np.lexsort((sid, -met, run))
        centre = np.repeat(sid[order[first]], size)
        other = centre != sid
        yield pa.record_batch([pa.array(sid[other]), pa.array(centre[other])], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (centre, salt, role): pairs (member, centre) that are similar."""
    known = Words()
    key, centres = None, []
    for batch in batches:
        out = []
        for centre, salt, role, sid, text in zip(*(batch.column(c).to_pylist() for c in ("centre", "salt", "role", "sid", "text")), strict=True):
            if key != (centre, salt):
                key, centres = (centre, salt), []
            tokens = shingles(text, known)
            if not len(tokens) or set_names(tokens)[0] != sid:
                continue  # another text under the same identifier
            if role == 0:
                if not any(len(c) == len(tokens) and (c == tokens).all() for c in centres):
                    centres.append(tokens)
                continue
            for own in centres:
                both = len(np.intersect1d(own, tokens, assume_unique=True))
                if DEN * both >= NUM * (len(own) + len(tokens) - both):
                    out.append((sid, centre))
        yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def verify(pairs: DataFrame, names: DataFrame, docs: DataFrame) -> DataFrame:
    """The similar ones of ``pairs`` (a, b) of set names.

    Each pair goes to its centre b; a centre with many members is copied once
    per ``STAR`` of them.  ``names``: (sid, doc_id) of a document per set;
    ``docs``: (doc_id, text).  Texts are fetched by identifier, with the list
    of wanted identifiers broadcast while it is short.
    """
    degree = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("members")).withColumn("salts", F.ceil(F.col("members") / STAR).cast("int"))
    members = pairs.join(degree, "b").select(F.col("a").alias("sid"), F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    centres = degree.select(F.col("b").alias("sid"), F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = stored(members.unionByName(centres).join(names, "sid"), "wanted")
    rows = docs.join(shared_if_small(wanted), "doc_id").select("centre", "salt", "role", "sid", "text")
    rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
    return rows.mapInArrow(_verify, "a bigint, b bigint").distinct()


def _rule_out(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            n = np.concatenate((batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()))
            bits = batch.column("sketch_a").to_pylist() + batch.column("sketch_b").to_pylist()
            i = np.flatnonzero(DEN * np.minimum(n[:k], n[k:]) >= NUM * np.maximum(n[:k], n[k:]))
            keep = pa.array(i[plausible(bits, n, i, i + k)])
            yield pa.record_batch([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs.mapInArrow(run, "a bigint, b bigint").distinct()


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in a unit that size and sketch do not rule out."""
    held: pa.Table | None = None

    def units(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        ends = np.append(starts[1:], rows.num_rows)
        sid, comp, n, side = (rows.column(c).to_numpy() for c in ("sid", "comp", "n", "side"))
        bits = rows.column("sketch").to_pylist()
        found = []
        for a, b in zip(starts, ends, strict=True):
            own, m = comp[a:b], n[a:b]
            if (own == own[0]).all():
                continue
            able = np.triu(own[:, None] != own[None, :], 1)
            if side[a:b].any() and not side[a:b].all():
                able &= side[a:b][:, None] != side[a:b][None, :]
            small, large = np.minimum(m[:, None], m[None, :]), np.maximum(m[:, None], m[None, :])
            able &= DEN * small >= NUM * large
            i, j = np.nonzero(able)
            if len(i):
                near = plausible(bits[a:b], m, i, j)
                found.append((sid[a:b][i[near]], sid[a:b][j[near]]))
        if found:
            x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            pairs = np.unique(np.column_stack((np.maximum(x, y), np.minimum(x, y))), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        keys = np.column_stack([rows.column(c).to_numpy() for c in ("hub", "i", "j")])
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.zeros(0, np.int64)
        last = int(starts[-1]) if len(starts) else 0
        held = rows.slice(last)
        yield from units(rows.slice(0, last), starts[:-1])
    if held is not None and held.num_rows:
        yield from units(held, np.zeros(1, np.int64))


def star_pairs(shared: DataFrame) -> DataFrame:
    """For each set the one set (a, b) that it shares most signatures with among those that meet most others.

    The original of a group of edited copies shares more with each of them
    than they share with each other, so it becomes the centre of the group.
    """
    company = stored(shared.mapInArrow(_company, "sid bigint, met bigint").groupBy("sid").agg(F.sum("met").alias("met")), "company")
    if company.count() <= BROADCAST_ROWS:
        rows = shared.join(F.broadcast(company), "sid")
    else:
        rows = shared.join(company, "sid").repartition("sig").sortWithinPartitions("sig")
    common = rows.select("sig", "sid", "met").mapInArrow(_centres, "a bigint, b bigint").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return common.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))


def remaining_pairs(shared: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of sets that share a signature and are in different components so far."""
    known = stored(known.select(F.col("node").alias("sid"), "component"), "known")
    labelled = shared.join(shared_if_small(known), "sid", "left")
    labelled = labelled.select("sig", "sid", F.coalesce("component", "sid").alias("comp"))
    # A signature's rows lie together, so its bounds are nearly done before they are shuffled.
    mixed = labelled.groupBy("sig").agg(F.min("comp").alias("hub"), F.max("comp").alias("other")).where("hub != other")
    mixed = stored(mixed.select("sig", "hub"), "mixed")
    # Signatures with the same least component make one group: their pairs are looked at once.
    groups = stored(labelled.join(shared_if_small(mixed), "sig").select("hub", "sid", "comp").distinct(), "groups")
    sizes = stored(groups.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "sizes")
    met = groups.join(shared_if_small(sizes), "hub").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    units = met.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("hub", "sid", "comp", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), (F.col("block") > F.col("x")).cast("int").alias("side"))
    work = units.join(sets.select("sid", "n", "sketch"), "sid").select("hub", "i", "j", "sid", "comp", "n", "side", "sketch")
    work = work.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "sid")
    return work.mapInArrow(_compare_blocks, "a bigint, b bigint").distinct()


def identifier_links(usable: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) from each identifier with several sets to the node of each of them."""
    bounds = [f(c).alias(f"{k}_{c}") for c in ("sid", "chk") for k, f in (("lo", F.min), ("hi", F.max))]
    several = usable.groupBy("doc_id").agg(*bounds).where("lo_sid != hi_sid or lo_chk != hi_chk")
    several = stored(several.select("doc_id"), "several")
    own = usable.join(shared_if_small(several), "doc_id").select("sid", "chk", F.col("doc_id").alias("a")).distinct()
    return own.join(sets.select("sid", "chk", F.col("doc_id").alias("b")), ["sid", "chk"]).select("a", "b")


def least_power(counts: dict[int, int]) -> int:
    """The least power of two from which on at most ``HOT_KEPT`` hashes were met that often."""
    kept, least = 0, max(counts, default=0) + 1
    for power in sorted(counts, reverse=True):
        kept += counts[power]
        if kept > HOT_KEPT:
            break
        least = power
    return least


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id.

    Words are runs without white space, with A-Z lower-cased; documents with
    fewer than five words have one shingle, those without words none, and
    these link with nothing, as do rows without an identifier (component
    null).  component_id is the smallest identifier reachable by links.
    Repeated rows are copies of one document; an identifier with several texts
    is one node with the links of all, except that its rows without words stay
    on their own.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    described = stored(texts.mapInArrow(_describe, "doc_id bigint, n bigint, sid bigint, chk bigint, sketch binary, hash bigint, met bigint"), "described")
    base = described.where("hash is null").select("doc_id", "n", "sid", "chk", "sketch")
    usable = base.where("sid is not null and doc_id is not null")
    frequent = described.where("hash is not null").groupBy("hash").agg(F.sum("met").alias("met")).where(F.col("met") >= HOT)
    frequent = stored(frequent.withColumn("power", F.floor(F.log2("met")).cast("int")), "frequent")
    least = least_power({r.power: r["count"] for r in frequent.groupBy("power").count().collect()})
    hot = np.array([r.hash for r in frequent.where(F.col("power") >= least).select("hash").toLocalIterator()], np.int64).view(np.uint64)
    shared_hot = spark.sparkContext.broadcast(Hot(hot))

    signed = texts.where("doc_id is not null").select("text").mapInArrow(_sign(shared_hot), "sig bigint, sid bigint")
    shared = stored(signed.repartition("sig").sortWithinPartitions("sig", "sid").mapInArrow(_shared_runs, "sig bigint, sid bigint"), "shared")

    sets = stored(usable.groupBy("sid", "chk").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "sets")
    names = sets.select("sid", "doc_id")
    first = stored(verify(stored(_rule_out(star_pairs(shared), sets), "stars"), names, texts), "first")
    pairs = stored(remaining_pairs(shared, components(first), sets), "pairs")
    rest = stored(verify(pairs, names, texts), "rest")

    edges = first.unionByName(rest)
    joined = edges.join(names.select(F.col("sid").alias("a"), F.col("doc_id").alias("x")), "a").join(names.select(F.col("sid").alias("b"), F.col("doc_id").alias("y")), "b")
    links = joined.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(identifier_links(usable, sets))
    found = components(links)
    least = sets.select("sid", "chk", F.col("doc_id").alias("node")).join(found, "node", "left").select("sid", "chk", F.coalesce("component", "node").alias("component"))
    out = base.join(least, ["sid", "chk"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
