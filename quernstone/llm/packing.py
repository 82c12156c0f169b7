"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm."""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import body, cut

#: Characters beside which a space is not a safe place to divide a text.
_AWKWARD = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
_WIDE_SPACE = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: Distinct words whose ids one Python worker keeps; beyond it only those of the texts at hand stay.
_KEPT_WORDS = 300_000
#: Longer words are forgotten after each run of texts, so the table has a size bound.
_KEPT_CHARS = 256
#: Characters of text that are divided at a time.
_SLICE = 2_000_000


def spaced(text: str) -> str | None:
    """The text with a space at each place where a new word begins, null where it has other spaces and _SAFE_SPACE tells.

    A byte-level BPE always begins a new word with a single space between two non-spaces. Single line feeds between two
    non-spaces are words of their own there, so a text without other white space is cut before them too: a part that begins
    with a line feed follows no space, any other but the first follows one.
    """
    if any(x in text for x in _AWKWARD):
        return None
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if _WIDE_SPACE.search(text):
            return None
    return text.replace("\n", " \n")


class _ByteLevelIds:
    """Ids of whole texts as the tokenizers library gives them, asked for once per distinct word."""

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        pre = made["pre_tokenizer"] or {}
        self.divisible = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not made["normalizer"]
        self.special = [x["content"] for x in made["added_tokens"]]
        self.divisible = self.divisible and not any(re.search(r"\s", x) for x in self.special)
        self.ranked = None
        if ranks_path and self.divisible:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.newline = ranks[b"\n"]
        self.kept: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """``words`` follow a space each, but those that begin with a line feed."""
        spaced, lines = [w for w in words if w[:1] != "\n"], [w for w in words if w[:1] == "\n"]
        self.kept.update(zip(spaced, self._encode([" " + w for w in spaced]), strict=True))
        if lines:
            feed = self._encode(["\n"])[0]
            self.kept.update((w, feed + ids) for w, ids in zip(lines, self._encode([w[1:] for w in lines]), strict=True))

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.ranked or len(texts) < 2:
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        joined = "\n".join(texts)
        plain, rest = texts, []
        if joined.count("\n") >= len(texts) or _BEYOND_LATIN.search(joined) or any(x in joined for x in self.special) or "" in texts:
            odd = lambda t: not t or "\n" in t or _BEYOND_LATIN.search(t) or any(x in t for x in self.special)
            rest = [t for t in texts if odd(t)]
            plain = [t for t in texts if not odd(t)]
            joined = "\n".join(plain)
        # a line feed between two texts that don't begin or end with white space, but for a space in front, is one id
        ids = np.array(self.ranked.encode_ordinary(joined), dtype="<u4")
        ends = [*np.flatnonzero(ids == self.newline).tolist(), len(ids)]
        raw = ids.tobytes()
        cut_up = [raw[4 * a : 4 * b] for a, b in zip([0, *[end + 1 for end in ends[:-1]]], ends, strict=True)]
        if not rest:
            return cut_up
        found = dict(zip(plain, cut_up if plain else [], strict=True))
        found.update((t, array("I", x.ids).tobytes()) for t, x in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return [found[t] for t in texts]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.divisible:
            return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        marked, seen = [spaced(t) for t in texts], set()
        plain = iter(self._joined(pc.split_pattern(pa.array([m for m in marked if m is not None], pa.large_string()), " "), seen))
        odd = iter(self._joined(pa.array([_SAFE_SPACE.split(t) for t, m in zip(texts, marked, strict=True) if m is None], pa.large_list(pa.large_string())), seen))
        if len(self.kept) > _KEPT_WORDS:
            self.kept = {w: self.kept[w] for w in seen if w in self.kept}
        return [next(odd if m is None else plain) for m in marked]

    def _joined(self, parts: pa.Array, seen: set[str]) -> list[bytes]:
        """Ids of texts given by their parts, which are added to ``seen``. The parts stand as numbers of the distinct ones, so Python sees only these."""
        at = parts.offsets.to_numpy().astype(np.int64)
        first = [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(parts.values.take(parts.offsets[:-1]).to_pylist(), add_special_tokens=False)]
        follows = np.ones(len(parts.values), dtype=bool)
        follows[at[:-1]] = False
        words = parts.values.filter(pa.array(follows)).dictionary_encode()
        distinct, numbers = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        seen.update(distinct)
        new = [w for w in distinct if w not in self.kept]
        self._learn(new)
        known = [*map(self.kept.__getitem__, distinct)]
        for w in new:
            if len(w) > _KEPT_CHARS:
                del self.kept[w]
        flat, size = np.frombuffer(b"".join(known), dtype="<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        length = size[numbers]
        ends = np.cumsum(length)
        ids = flat[np.repeat((np.cumsum(size) - size)[numbers] - (ends - length), length) + np.arange(length.sum())].tobytes()
        cuts = np.append(0, 4 * ends)[at - np.arange(len(at))].tolist()
        return [a + ids[start:end] for a, start, end in zip(first, cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def _ids(path: str, ranks_path: str | None) -> _ByteLevelIds:
    return _ByteLevelIds(path, ranks_path)


def slices(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about _SLICE characters, so that a batch of long texts is not divided at once."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _SLICE:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def piece_bounds(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole ones of ``most``, and if need be a shorter one in front."""
    head = n % most if n > most else n
    bounds = [(0, head)] if head else []
    return bounds + [(at, most) for at in range(head, n, most)]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int | None, capacity: int, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut the long ones: (row, <id_col>, piece, start, length, ids_crc32[, ids]).

    ``row`` numbers the input rows, so repeated or null identifiers stay apart. A null text is empty and, with an
    ``end_id``, one piece of one id; without one it has no pieces. Other columns of ``docs`` are not read.
    """
    names = ["row", "id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer_path, ranks_path)
        tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in slices(texts):
                out: list[list] = [[] for _ in names]
                for k, raw in enumerate(encode(texts[part]), part.start):
                    raw += tail
                    for piece, (start, n) in enumerate(piece_bounds(len(raw) // 4, capacity)):
                        own = raw[4 * start : 4 * (start + n)]
                        for column, value in zip(out, (k, k, piece, start, n, zlib.crc32(own), own), strict=False):
                            column.append(value)
                at = pa.array(out[0], pa.int64())
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(out[2], pa.int32()), *(pa.array(x, pa.int64()) for x in out[3:6])]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(out[6]), dtype="<u4").astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *out[4]]), pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), body(text_col).alias("text"))
    return rows.mapInArrow(cut_up, f"row long, id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class _Bins:
    """Open bins by the room left in them; a bit mask of the rooms on offer finds the tightest one."""

    def __init__(self, capacity: int, room: np.ndarray):
        self.capacity, self.count, self.mask = capacity, len(room), 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b in np.flatnonzero(room).tolist():
            self.by_room[room[b]].append(b)
        for r in set(room.tolist()) - {0}:
            self.mask |= 1 << r

    def put(self, length: int) -> int:
        fits = self.mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            found = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask ^= 1 << room
        else:
            room, found = self.capacity, self.count
            self.count += 1
        if room > length:
            self.by_room[room - length].append(found)
            self.mask |= 1 << (room - length)
        return found


class Packer:
    """One island: a population of packings of the same items, as bin numbers by item (longest item first)."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity, self.rng = lengths, capacity, np.random.default_rng(seed)
        self.bound = self._bound()

    def _bound(self) -> int:
        """No packing has fewer bins: items over half a bin stand alone, and for each k those between k and a half can
        only use the room beside the ones that leave k or more."""
        n = np.bincount(self.lengths, minlength=self.capacity + 1)
        count, total = np.cumsum(n), np.cumsum(n * np.arange(len(n)))
        half, k = self.capacity // 2, np.arange(self.capacity // 2 + 1)
        lone, beside = count[-1] - count[self.capacity - k], count[self.capacity - k] - count[half]
        room = beside * self.capacity - (total[self.capacity - k] - total[half])
        small = total[half] - total[np.maximum(k - 1, 0)] * (k > 0)
        return int((lone + beside + np.maximum(0, -(-(small - room) // self.capacity))).max())

    def population(self, size: int, noise: float) -> list[np.ndarray]:
        """Best fit in order of length, an exact fill, and best fit in disturbed orders; the first alone if none can be better."""
        first = self.fresh(0.0)
        if self.cost(first)[0] <= self.bound:
            return [first] * size
        return [first, self.tight(), *[self.fresh(noise + 0.04 * p) for p in range(2, size)]]

    def fill(self, packing: np.ndarray) -> np.ndarray:
        return np.bincount(packing, weights=self.lengths).astype(np.int64)

    def cost(self, packing: np.ndarray) -> tuple[int, float]:
        """Bins used; among equals, the packing whose bins are more unevenly filled leaves more usable room."""
        fill = self.fill(packing)
        return len(fill), -float(((fill / self.capacity) ** 2).sum())

    def best_fit(self, packing: np.ndarray, room: np.ndarray, items: np.ndarray) -> np.ndarray:
        bins = _Bins(self.capacity, room)
        packing[items] = [bins.put(n) for n in self.lengths[items].tolist()]
        return packing

    def fresh(self, noise: float) -> np.ndarray:
        order = np.argsort(-self.lengths * self.rng.uniform(1 - noise, 1 + noise, len(self.lengths)), kind="stable")
        return self.best_fit(np.zeros(len(order), dtype=np.int64), np.zeros(0, dtype=np.int64), order)

    def tight(self) -> np.ndarray:
        """Open each bin with the longest item left and look for one, two or three others that fill it exactly.

        Where none do, the longest that fits goes in and the search goes on; the choice among pairs is by chance.
        """
        left = np.bincount(self.lengths, minlength=self.capacity + 1)
        left[0] = 0
        at = np.searchsorted(-self.lengths, -np.arange(self.capacity + 1))
        packing, used, top = np.zeros(len(self.lengths), dtype=np.int64), 0, self.capacity

        def take(n: int) -> int:
            packing[at[n]] = used
            at[n] += 1
            left[n] -= 1
            return n

        def pair(room: int) -> int:
            """The longer one of two items that fill the room, or 0."""
            a = np.arange((room + 1) // 2, room)
            fits = a[(left[a] > 0) & (left[room - a] > (2 * a == room))]
            return int(fits[self.rng.integers(len(fits))]) if len(fits) else 0

        while True:
            while top and not left[top]:
                top -= 1
            if not top:
                return packing
            room = self.capacity - take(top)
            while room:
                if left[room]:
                    take(room)
                    break
                if a := pair(room):
                    take(a)
                    take(room - a)
                    break
                fits = np.flatnonzero(left[: room + 1])[::-1]
                if not len(fits):
                    break
                third = next((n for n in fits[:6].tolist() if (left[n] > 2 or 3 * n > 2 * room) and (a := pair(room - n)) and left[n] > (n in (a, room - n - a))), 0)
                room -= take(third or int(fits[0]))
            used += 1

    def cross(self, ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Inject well-filled bins of ``theirs`` whole, drop our bins that hold the same items, best-fit what is left over."""
        full = self.fill(theirs) >= self.capacity - int(self.rng.choice([0, 0, 1, 3, 8]))
        our_fill = self.fill(ours)
        harmed = np.zeros(len(full), dtype=bool)
        harmed[theirs[our_fill[ours] == self.capacity]] = True
        take = full & ~(harmed & (self.rng.random(len(full)) < 0.9))
        take &= self.rng.random(len(full)) < self.rng.uniform(0.5, 1)
        injected = take[theirs]
        gone = np.zeros(len(our_fill), dtype=bool)
        gone[ours[injected]] = True
        gone |= (our_fill < self.capacity) & (self.rng.random(len(gone)) < 0.5)  # mutation: reopen some bins with room
        stay = ~injected & ~gone[ours]
        names = np.full(len(ours), -1, dtype=np.int64)
        names[stay] = ours[stay]
        names[injected] = len(our_fill) + theirs[injected]
        held = names >= 0
        used, dense = np.unique(names[held], return_inverse=True)
        child = np.zeros(len(ours), dtype=np.int64)
        child[held] = dense
        room = self.capacity - np.bincount(dense, weights=self.lengths[held], minlength=len(used)).astype(np.int64)
        return self.best_fit(child, room, np.flatnonzero(~held))

    def evolve(self, population: list[np.ndarray], births: int) -> list[np.ndarray]:
        """Best first. Ends early at the lower bound, which no packing can beat."""
        ranked = sorted(((self.cost(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
        for k in range(births):
            if ranked[0][0][0] <= self.bound:
                break
            a, b = self.rng.choice(len(ranked), 2, replace=False)
            child = self.cross(ranked[min(a, b)][2], ranked[max(a, b)][2])
            cost = self.cost(child)
            if all(cost != x[0] for x in ranked) and cost < ranked[-1][0]:
                ranked = sorted([*ranked[:-1], (cost, len(population) + k, child)], key=lambda x: x[:2])
        return [p for _, _, p in ranked]


def pack(pieces: DataFrame, capacity: int = 1024, cell_items: int = 16384, islands: int = 3, epochs: int = 3, births: int = 8, population: int = 4) -> DataFrame:
    """Add (sequence_id, offset) to ``pieces`` (row, piece, length, ...): each piece gets a place in one sequence.

    Pieces as long as a sequence fill one each. The others are dealt by hash into cells of about ``cell_items``, a
    bound that does not move with the input. Each cell is packed by ``islands`` grouping genetic populations that
    run as separate rows of a Spark job; after each of ``epochs`` the elite of an island moves to the next one of its
    cell through a join. Sequence ids are unique but not dense. An empty input gives an empty result.
    """
    whole = pieces.where(F.col("length") >= capacity)
    rest = pieces.where(F.col("length") < capacity)
    count = rest.count()
    cells = max(1, -(-count // cell_items))
    order = Window.partitionBy("cell").orderBy(F.desc("length"), "row", "piece")
    items = cut(rest.withColumn("cell", F.pmod(F.xxhash64("row", "piece"), F.lit(cells))).withColumn("pos", F.row_number().over(order) - 1))

    def island_rows(batches: Iterator[pa.RecordBatch], epoch: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"cell": [], "island": [], "lengths": [], "bred": [], "elite": [], "bins": [], "spread": []}
            for k in range(batch.num_rows):
                cell, island = batch.column("cell")[k].as_py(), batch.column("island")[k].as_py()
                lengths = batch.column("lengths")[k].values.to_numpy()
                packer = Packer(lengths, capacity, hash((cell, island, epoch)) & 0xFFFFFFFF)
                if epoch:
                    bred = [*np.split(batch.column("bred")[k].values.to_numpy(), population), batch.column("migrant")[k].values.to_numpy()]
                else:
                    bred = packer.population(population, 0.04 * island)
                bred = packer.evolve(bred, births)[:population]
                bins, spread = packer.cost(bred[0])
                for name, value in (("cell", cell), ("island", island), ("lengths", lengths), ("bred", np.concatenate(bred).astype(np.int32)), ("elite", bred[0].astype(np.int32)), ("bins", bins), ("spread", spread)):
                    out[name].append(value)
            kinds = {"cell": pa.int64(), "island": pa.int32(), "bins": pa.int32(), "spread": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.list_(pa.int32()))) for n, v in out.items()], [*out])

    schema = "cell long, island int, lengths array<int>, bred array<int>, elite array<int>, bins int, spread double"
    start = items.groupBy("cell").agg(F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("lengths"))
    state = start.withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).repartition(max(1, min(islands * cells, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "cell", "island")
    state = cut(state.mapInArrow(lambda x: island_rows(x, 0), schema))
    for epoch in range(1, epochs):
        migrants = state.select("cell", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("migrant"))
        state = cut(state.drop("elite").join(migrants, ["cell", "island"]).mapInArrow(lambda x, e=epoch: island_rows(x, e), schema))
    best = state.groupBy("cell").agg(F.min_by("elite", F.struct("bins", "spread", "island")).alias("packing"))
    placed = best.select("cell", F.posexplode("packing").alias("pos", "bin"))
    before = Window.partitionBy("cell", "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    packed = items.join(placed, ["cell", "pos"]).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    packed = packed.withColumn("sequence_id", 2 * (F.col("cell") * cell_items * 16 + F.col("bin"))).drop("cell", "pos", "bin")
    alone = whole.withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1)
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int | None = 2, capacity: int = 1024, ranks_path: str | None = None, **how) -> DataFrame:
    """Tokenise, cut and pack whole documents: (<id>, piece, start, length, ids_crc32, sequence_id, offset).

    A null text is empty and has the end id alone, so it has a piece like any other; without an end id it has none.
    Repeated rows and null identifiers are packed each; a text of any length is cut into pieces; other columns are not
    read; an empty table gives no rows. The pieces are saved before they are packed, so their numbers can't change; save
    the result of a shuffle before it comes here.
    """
    pieces = cut(token_pieces(docs, id_col, text_col, tokenizer_path, end_id, capacity, ranks_path))
    packed = pack(pieces, capacity, **how)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
