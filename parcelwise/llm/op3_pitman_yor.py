"""Language-model scoring by a hierarchical Pitman-Yor model.

Every context, the word before, is a restaurant whose customers are the words that follow it in training; every table sends a
customer for its word to the restaurant of all words, the shared parent, whose tables draw from a uniform base over the training
vocabulary and one unknown word. Seating is sampled by Gibbs: customers leave and sit down again, at a table of their word by its
size less the discount, or at a new one by the parent's probability. The predictive probability is averaged over the samples and
gives the score and the perplexity of each text.

On the cluster, texts are read in blocks (`BLOCK_CHARS` characters of neighbouring rows). A block counts its words and its pairs
of words, and asks for what the corpus knows of them: one request to each partition of contexts, one to each partition of words.
The partitions add up the requests of all blocks, seat their restaurants, and answer. A frequent context is dealt over all
partitions by the word that follows, so no task holds a hot restaurant. Only sums and the tables of the frequent contexts reach
the driver. Words are known by a 64-bit hash.

Tokens are the words in lower case (A-Z) and one end for each text; training skips texts whose crc32 of the id has remainder 2
modulo 7.

Nulls: a null text is empty and scores its end alone; a null doc_id is in training. Repeated rows count and are scored each on
their own. Without training tokens every probability is that of the base. An empty table gives an empty table. Extra columns are
ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WHITE, partitions, table, whole

NAME = "op3_pitman_yor"
ORACLE_SQL = None  # seating is not expressible; tests compare counts and base with plain sums, and the model with its formulas
FOLDS, HELD = 7, 2
#: Discount and concentration of the contexts, and of their parent.
DISCOUNT, STRENGTH = 0.8, 4.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.5, 1.0
BURN_IN, SAMPLES, MOVES = 2, 4, 4
SEED = 5
BLOCK_CHARS = 8_000_000
#: Contexts above this share of a sample's words are dealt over all partitions: at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000
#: Pairs of more customers than this have their tables redrawn by sweep, not customer by customer.
LARGE = 256
START, END = b"\0start", b"\0end"

SCHEMA = "kind string, block string, part int, payload binary"
_ROW = pa.schema([("kind", pa.string()), ("block", pa.string()), ("part", pa.int32()), ("payload", pa.binary())])


# -- arrays as bytes ------------------------------------------------------------------------------------------------------------

def _planes(a: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, no wider than the largest needs."""
    a = np.ascontiguousarray(a, "<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + len(a).to_bytes(4, "little") + a.view("u1").reshape(-1, 8)[:, :width].T.tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(map(_planes, arrays))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        width, n = raw[at], int.from_bytes(raw[at + 1:at + 5], "little")
        a = np.zeros((n, 8), "u1")
        a[:, :width] = np.frombuffer(raw, "u1", n * width, at + 5).reshape(width, n).T
        out.append(a.reshape(-1).view("<u8"))
        at += 5 + n * width
    return out


def rising(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; `np.cumsum` turns them back."""
    return np.diff(a, prepend=np.uint64(0))


# -- blocks ---------------------------------------------------------------------------------------------------------------------

def is_held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


class Block:
    """Texts as numbers of the block's words, in the order of the words' hashes."""

    def __init__(self, ids: list, texts: list[str], name: str):
        import xxhash

        words, lengths = [], []
        for t in texts:
            found = t.encode("utf-8", "surrogatepass").lower().split()
            words += found
            words.append(END)
            lengths.append(len(found) + 1)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known.append(START)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), "u8", len(known))
        order = np.argsort(hashes)
        self.words = hashes[order]
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        self.start, self.end = int(place[-1]), int(place[known.index(END)])
        self.ids, self.name = ids, name
        self.lengths = np.array(lengths, "i8")
        self.held = np.array([is_held(i) for i in ids], bool)
        self._tokens = place[coded.indices.to_numpy()]
        self.finish()

    def finish(self) -> None:
        """Counts of words."""
        self.trained = np.repeat(~self.held, self.lengths)
        self.counts = np.bincount(self._tokens[self.trained], minlength=len(self.words))

    def pair(self) -> None:
        """The distinct pairs, by context and word: for who asks for them, since they are sorted for it."""
        n, v = len(self._tokens), len(self.words)
        first = np.cumsum(self.lengths) - self.lengths
        before = np.empty(n, "i8")
        before[1:] = self._tokens[:-1]
        before[first] = self.start
        keys, self.pair_of = np.unique(before * v + self._tokens, return_inverse=True)
        self.context, self.word = np.divmod(keys, v)
        self.pair_counts = np.bincount(self.pair_of[self.trained], minlength=len(keys))

    def parts(self, n: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The partition of each word and of each pair: of its context, or of its word where the context is frequent."""
        own = part_of(self.words, n)
        often = np.isin(self.words, hot)
        return own, np.where(often[self.context], own[self.word], own[self.context])


def part_of(words: np.ndarray, n: int) -> np.ndarray:
    """Ranges of hashes, by their upper 32 bits."""
    return ((words >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype("i8")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of a partition. A block is named by its rows, so that it finds its answers however often it is read again."""
    ids, texts, chars = [], [], 0

    def made() -> Block:
        mark = blake2b(repr(ids).encode(), digest_size=16)
        for t in texts:
            mark.update(t.encode("utf-8", "surrogatepass") + b"\xff")
        return Block(ids, texts, mark.hexdigest())

    for batch in batches:
        for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py())
            chars += len(texts[-1]) + 1
            if chars >= BLOCK_CHARS:
                yield made()
                ids, texts, chars = [], [], 0
    if ids:
        yield made()


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, places that go to it, rising)."""
    order = np.argsort(part, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
    for at in np.split(order, begin[1:]):
        if len(at):
            yield int(part[at[0]]), at


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _pair_requests(n: int, hot: np.ndarray):
    """For each block and partition: contexts, pairs of each, words (40 bits), training counts, and the words' local frequency."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            b.pair()
            _, part = b.parts(n, hot)
            share = np.rint(8 * np.log2((b.counts + 0.5) / (b.counts.sum() + 1))).clip(-255, 0)  # in eighths of a power of two
            rows = []
            for p, at in _dealt(part):
                context, size = np.unique(b.context[at], return_counts=True)
                w = b.word[at]
                rows.append(("pairs", b.name, p, pack(rising(b.words[context]), size, b.words[w] >> np.uint64(24), b.pair_counts[at], -share[w])))
            if rows:
                yield _rows(rows)
    return run


def _word_requests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            rows = [("words", b.name, p, pack(rising(b.words[at]), b.counts[at])) for p, at in _dealt(part_of(b.words, n))]
            if rows:
                yield _rows(rows)
    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches):
        # numbers by falling frequency are small; `rank` leads back to the order of hashes
        rank = np.argsort(-np.bincount(b._tokens, minlength=len(b.words)), kind="stable")
        small = np.empty(len(rank), "i8")
        small[rank] = np.arange(len(rank))
        ids = np.array([0 if i is None else i for i in b.ids], "i8").view("u8")
        null = np.array([i is None for i in b.ids], "u8")
        yield _rows([("texts", b.name, -1, pack(ids, null, b.lengths, small[b._tokens], rank, rising(b.words), [b.start, b.end]))])


def _read_texts(payload: bytes) -> Block:
    ids, null, lengths, tokens, rank, words, ends = unpack(payload)
    b = Block.__new__(Block)
    b.ids = [None if x else int(i) for i, x in zip(ids.view("i8"), null, strict=True)]
    b.lengths, b.words = lengths.astype("i8"), np.cumsum(words, dtype="u8")
    b._tokens = rank.astype("i8")[tokens.astype("i8")]
    b.start, b.end = map(int, ends)
    b.held = np.array([is_held(i) for i in b.ids], bool)
    b.finish()
    return b


# -- seating --------------------------------------------------------------------------------------------------------------------

def seat(customers: np.ndarray, room: np.ndarray, parent: np.ndarray, scale: np.ndarray, discount: float, strength: float, rng) -> np.ndarray:
    """Mean tables of each dish over the samples.

    The first seating lets customers come in doubling waves; from it, sweeps move customers one by one. A dish has `customers` in restaurant `room`, and probability `parent` above it. `scale` is how many times a room is larger
    than what is seen of it here.
    """
    def come(dishes: np.ndarray) -> np.ndarray:
        """Tables after the dishes' customers came in doubling waves, each with the chance of a new table as of its begin."""
        n, k, all_ = np.ones(len(dishes)), np.ones(len(dishes)), customers[dishes]
        while len(dishes) and (n < all_).any():
            wave = np.minimum(n, all_ - n)
            k = k + rng.binomial(wave.astype("i8"), fresh[dishes] / (n - discount * k + fresh[dishes]))
            n = n + wave
        return k

    tables = (customers > 0).astype("f8")
    fresh = (strength + discount * np.bincount(room, tables, minlength=len(scale))[room] * scale[room]) * parent
    many = np.flatnonzero((customers > 1) & (customers <= LARGE))
    large = np.flatnonzero(customers > LARGE)
    c = customers[many].astype("i8")
    first = np.cumsum(c) - c
    table_of = np.repeat(first, c)  # every customer's table, as the place of one of its seats
    size = np.zeros(int(c.sum()), "i8")
    t = come(many)
    size[first] = c - t + 1
    own = np.arange(int(c.sum())) - np.repeat(first, c)  # the others begin with a customer each
    single = (own > 0) & (own < np.repeat(t, c))
    table_of[single] = np.flatnonzero(single)
    size[single] = 1
    total = np.zeros(len(customers))
    for sweep in range(BURN_IN + SAMPLES):
        in_room = np.bincount(room, tables, minlength=len(scale)) * scale
        fresh = (strength + discount * in_room[room]) * parent
        for _ in range(MOVES if len(many) else 0):
            who = first + (rng.random(len(c)) * c).astype("i8")
            left = table_of[who]
            size[left] -= 1
            t -= size[left] == 0
            new = rng.random(len(c)) * (c - 1 - discount * t + fresh[many]) < fresh[many]
            wait = np.flatnonzero(~new)
            while len(wait):  # a table by its size less the discount: that of a random other customer, taken with the share that is left
                other = first[wait] + (rng.random(len(wait)) * c[wait]).astype("i8")
                at = table_of[other]
                sits = (other != who[wait]) & (rng.random(len(wait)) * size[at] < size[at] - discount)
                table_of[who[wait[sits]]] = at[sits]
                size[at[sits]] += 1
                wait = wait[~sits]
            for k in np.flatnonzero(new):
                free = first[k] + int(np.argmin(size[first[k]:first[k] + c[k]]))
                table_of[who[k]] = free
                size[free] = 1
            t += new
        tables[many] = t
        tables[large] = come(large)
        if sweep >= BURN_IN:
            total += tables
    return total / SAMPLES


def _seat_contexts(n: int, hot: np.ndarray, seed: int):
    """Answers a partition's pair requests: customers and mean tables of each pair, mean tables of each context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, part, read = [], 0, []
        for batch in batches:
            for b, p, payload in zip(batch.column("block"), batch.column("part"), batch.column("payload"), strict=True):
                blocks.append(b.as_py())
                part = p.as_py()
                read.append(unpack(payload.as_py()))
        order = sorted(range(len(blocks)), key=blocks.__getitem__)  # the sample does not depend on arrival
        blocks, read = [blocks[i] for i in order], [read[i] for i in order]
        contexts = [np.cumsum(r[0], dtype="u8") for r in read]
        context = np.concatenate([np.repeat(u, r[1].astype("i8")) for u, r in zip(contexts, read, strict=True)])
        word = np.concatenate([r[2] for r in read])
        key = (context ^ (context >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F)
        _, at, pair = np.unique(key, return_index=True, return_inverse=True)
        customers = np.bincount(pair, np.concatenate([r[3] for r in read]).astype("f8"), len(at))
        share = np.concatenate([r[4] for r in read]).astype("f8")[at]
        rooms, room = np.unique(context[at], return_inverse=True)
        often = np.isin(rooms, hot)
        mean = seat(customers, room, 2.0 ** (-share / 8), np.where(often, float(n), 1.0), DISCOUNT, STRENGTH, np.random.default_rng((seed, part)))
        in_room = np.bincount(room, mean, len(rooms))
        out, begin = [], 0
        for b, u, r in zip(blocks, contexts, read, strict=True):
            mine = pair[begin:begin + len(r[2])]
            begin += len(mine)
            out.append(("pairs", b, part, pack(customers[mine], np.rint(16 * mean[mine]), np.rint(16 * in_room[np.searchsorted(rooms, u)]))))
        if often.any():
            out.append(("hot", "", part, pack(rising(rooms[often]), np.rint(16 * in_room[often]))))
        words, w = np.unique(word[at], return_inverse=True)
        tables = np.rint(16 * np.bincount(w, mean, len(words)))
        words, tables = words[tables > 0], tables[tables > 0]
        out += [("tables", "", p, pack(rising(words[to]), tables[to])) for p, to in _dealt(part_of(words << np.uint64(24), n))]
        yield _rows(out)
    return run


def _seat_words(seed: int):
    """Answers a partition's word requests: training count and what the parent restaurant serves of each word; and sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, asked, served, part = [], [], [], 0
        for batch in batches:
            for kind, b, p, payload in zip(*[batch.column(c) for c in ("kind", "block", "part", "payload")], strict=True):
                part = p.as_py()
                arrays = unpack(payload.as_py())
                arrays[0] = np.cumsum(arrays[0], dtype="u8")
                if kind.as_py() == "words":
                    blocks.append(b.as_py())
                    asked.append(arrays)
                else:
                    served.append(arrays)
        if not asked:
            return
        words, w = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        counts = np.bincount(w, np.concatenate([a[1] for a in asked]).astype("f8"), len(words))
        customers = np.zeros(len(words))
        if served:
            short, tables = np.concatenate([s[0] for s in served]), np.concatenate([s[1] for s in served]).astype("f8") / 16
            known, at = np.unique(short, return_inverse=True)
            sums = np.bincount(at, tables, len(known))
            mine = words >> np.uint64(24)
            i = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            customers = np.where((known[i] == mine) & (counts > 0), sums[i], 0.0)
        seen = int((counts > 0).sum())
        # one room for all words, of which a partition sees its part
        whole_ = np.rint(customers).astype("i8")
        base = np.full(len(words), 1.0 / max(1, seen))
        tables = seat(whole_, np.zeros(len(words), "i8"), base, np.ones(1), PARENT_DISCOUNT, PARENT_STRENGTH, np.random.default_rng((seed, 1, part)))
        tables = np.minimum(tables, customers)
        served16 = np.rint(4096 * (customers - PARENT_DISCOUNT * tables))
        out, begin = [], 0
        for b, a in zip(blocks, asked, strict=True):
            mine = w[begin:begin + len(a[0])]
            begin += len(mine)
            out.append(("words", b, part, pack(counts[mine], served16[mine])))
        out.append(("sums", "", part, pack(np.rint([counts.sum(), seen, 4096 * customers.sum(), 4096 * tables.sum()]))))
        yield _rows(out)
    return run


def _score(n: int, hot: np.ndarray, hot_tables: np.ndarray, sums: tuple):
    """Scores the texts of a block from the answers to its requests."""
    n_train, n_vocabulary, n_customers, n_tables = sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, answers = [], {"pairs": {}, "words": {}}  # several texts: equal blocks
        for batch in batches:
            for kind, p, payload in zip(*[batch.column(c) for c in ("kind", "part", "payload")], strict=True):
                if kind.as_py() == "texts":
                    texts.append(payload.as_py())
                else:
                    answers[kind.as_py()][p.as_py()] = unpack(payload.as_py())
        if not texts or not answers["words"]:
            raise ValueError("a block was read in another way than when it asked")
        text = _read_texts(texts[0])
        text.pair()
        own, pair_part = text.parts(n, hot)
        count, served = np.zeros(len(text.words)), np.zeros(len(text.words))
        for p, at in _dealt(own):
            c, s = answers["words"][p]
            count[at], served[at] = c, s / 4096
        customers, tables, room = np.zeros(len(text.word)), np.zeros(len(text.word)), np.zeros(len(text.word))
        for p, at in _dealt(pair_part):
            c, t, in_room = answers["pairs"][p]
            customers[at], tables[at] = c, t / 16
            _, place = np.unique(text.context[at], return_inverse=True)
            room[at] = in_room[place] / 16
        often = np.isin(text.words, hot)
        if often.any():
            total = np.zeros(len(text.words))
            total[often] = hot_tables[np.searchsorted(hot, text.words[often])]
            at = often[text.context]
            room[at] = total[text.context[at]]
        visits = count[text.context]
        visits[text.context == text.start] = count[text.end]  # every training text begins once
        above = (served + (PARENT_STRENGTH + PARENT_DISCOUNT * n_tables) / (n_vocabulary + 1)) / (PARENT_STRENGTH + n_customers)
        p = np.maximum(customers - DISCOUNT * tables, 0) / (STRENGTH + visits) + (STRENGTH + DISCOUNT * room) / (STRENGTH + visits) * above[text.word]
        doc = np.repeat(np.arange(len(text.ids)), text.lengths)

        def by_doc(values: np.ndarray) -> np.ndarray:
            return np.bincount(doc, values, len(text.ids))

        plain = np.log10((count + 1) / (n_train + n_vocabulary + 1))
        score = by_doc(np.log10(p)[text.pair_of])
        made = pa.RecordBatch.from_arrays(
            [pa.array(text.ids, pa.int64()), pa.array(text.held), pa.array(text.lengths), pa.array(by_doc(count[text._tokens] > 0).astype("i8")),
             pa.array(np.full(len(text.ids), n_train, "i8")), pa.array(by_doc(plain[text._tokens])), pa.array(score), pa.array(10 ** (-score / text.lengths))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
        yield from [made] * len(texts)
    return run


def hot_contexts(rows: DataFrame, share: float = HOT_SHARE) -> np.ndarray:
    """Hashes of the most frequent words of one row in 64, or all rows of a small table; they only steer the dealing of work."""
    import xxhash

    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = some.select(F.explode(F.split(lower, WHITE)).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("c"))
    total = words.agg(F.sum("c").alias("n")).first()["n"] or 0
    top = words.filter(F.col("c") > max(1.0, share * total)).orderBy(F.desc("c"), "w").limit(int(1 / share)).collect()
    found = [r["w"].encode("utf-8", "surrogatepass") for r in top] + [START]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(w) for w in found], "u8"))


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, seed: int = SEED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    n, hot = partitions(spark), hot_contexts(rows)
    contexts = cut_lineage(rows.mapInArrow(_pair_requests(n, hot), SCHEMA).groupBy("part").applyInArrow(_seat_contexts(n, hot, seed), SCHEMA))
    asked = rows.mapInArrow(_word_requests(n), SCHEMA).unionByName(contexts.filter("kind = 'tables'"))
    words = cut_lineage(asked.groupBy("part").applyInArrow(_seat_words(seed), SCHEMA))
    parts = [unpack(r["payload"])[0] for r in words.filter("kind = 'sums'").collect()]  # four numbers a partition
    n_train, n_vocabulary, customers, tables = (sum(int(p[i]) for p in parts) for i in range(4))
    hot_tables = np.zeros(len(hot))
    for r in contexts.filter("kind = 'hot'").collect():  # the frequent contexts, once a partition
        found, t = unpack(r["payload"])
        hot_tables[np.searchsorted(hot, np.cumsum(found, dtype="u8"))] += t / 16
    answers = contexts.filter("kind = 'pairs'").unionByName(words.filter("kind = 'words'")).unionByName(rows.mapInArrow(_texts, SCHEMA))
    return answers.groupBy("block").applyInArrow(_score(n, hot, hot_tables, (n_train, n_vocabulary, customers / 4096, tables / 4096)),
                                                 "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
