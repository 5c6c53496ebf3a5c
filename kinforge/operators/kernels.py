"""The features of many pairs at once, over arrays of characters, words and grams: for joins of so many pairs that an
expression a pair takes too long. Values are those of kinforge.operators.features.

``met`` reads postings in order of their code, pairs both sides of each, and makes the features of some thousands at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs at a time, and postings.
PAIRS, ROWS = 16_384, 16_384
#: Characters of a name whose places fit a machine word; longer names take integers of any length.
WORD_BITS = 64


def ragged(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row for each count, with the next values from the left, and zeros; values are above zero."""
    table = np.zeros((len(counts), int(counts.max(initial=0))), dtype=values.dtype)
    table[np.arange(table.shape[1]) < counts[:, None]] = values
    return table


def sets(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values above zero, from the left, and their number."""
    ordered = np.sort(table, axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = 0
    ordered = -np.sort(-ordered, axis=1)
    n = np.count_nonzero(ordered, axis=1)
    return np.ascontiguousarray(ordered[:, : int(n.max(initial=0))]), n.astype(np.int32)


def numbered(values: np.ndarray, low: int) -> tuple[np.ndarray, int]:
    """Values above zero as numbers from 1 without gaps, and how many there are; zeros stay."""
    if low <= 1 << 24:
        there = np.zeros(low + 1, dtype=np.int32)
        there[values.ravel()] = 1
        there[0] = 0
        return (np.cumsum(there, dtype=np.int32) * there)[values], int(there.sum())
    found = np.unique(values[values > 0])
    return np.where(values > 0, np.searchsorted(found, values) + 1, 0).astype(np.int32), len(found)


def characters(text: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """A row of characters for each text, as numbers from 1, their number, and the highest number."""
    lengths = pc.utf8_length(text).to_numpy().astype(np.int32)
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]
    points = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    if points.max(initial=0) > 127:
        points = np.frombuffer(points.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    codes, most = numbered(points.astype(np.int32) + 1, int(points.max(initial=0)) + 1)
    return ragged(codes, lengths), lengths, most


def grams(chars: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sets of character 3-grams, numbered; a shorter text is its own only gram."""
    wide = np.zeros((len(chars), max(chars.shape[1], 3)), dtype=np.int64)
    wide[:, : chars.shape[1]] = chars
    base = most + 1
    windows = (wide[:, :-2] * base + wide[:, 1:-1]) * base + wide[:, 2:]
    windows[np.arange(windows.shape[1]) >= np.where(lengths == 0, 0, np.maximum(lengths - 2, 1))[:, None]] = 0
    codes, n = numbered(windows, base**3)
    return (*sets(codes), n)


class Words:
    """The words of texts that have two characters at least: numbers (from 1) by row, and which are digits."""

    def __init__(self, text: pa.Array):
        split = pc.split_pattern(text, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        kept = np.append(False, pc.utf8_length(words).to_numpy(zero_copy_only=False) >= 2) if len(words) else np.zeros(1, dtype=bool)
        codes = coded.indices.to_numpy().astype(np.int32) + 1
        counts = pc.list_value_length(split).to_numpy().astype(np.int32)
        row = np.repeat(np.arange(len(counts)), counts)[kept[codes]]
        codes = codes[kept[codes]]
        self.rows = ragged(codes, np.bincount(row, minlength=len(counts)))
        self.most = len(words)
        self.digits = np.append(False, pc.match_substring_regex(words, "^[0-9]+$").to_numpy(zero_copy_only=False)) if len(words) else kept

    def first(self) -> np.ndarray:
        """The first word of each row, or 0."""
        return self.rows[:, 0] if self.rows.shape[1] else np.zeros(len(self.rows), dtype=np.int32)

    def numbers(self) -> np.ndarray:
        return np.where(self.digits[self.rows], self.rows, 0)


class Places:
    """Where in each text each character is, as bits: of a machine word, or of integers of any length if a text has more characters."""

    def __init__(self, chars: np.ndarray, most: int):
        self.kind = np.uint64 if chars.shape[1] <= WORD_BITS else int
        self.width, self.limit = most + 1, max(WORD_BITS, chars.shape[1])
        bits = np.zeros((len(chars), self.width), dtype=self.kind if self.kind is np.uint64 else object)
        each = np.arange(len(chars))
        for i in range(chars.shape[1]):
            bits[each, chars[:, i]] |= self.kind(1 << i)
        bits[:, 0] = 0
        self.flat = bits.ravel()

    def held(self, x: np.ndarray) -> np.ndarray:
        return x.astype(self.flat.dtype)


def levenshtein(a: np.ndarray, n: np.ndarray, places: Places, at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances of texts a (a row for each place of characters, n of them) to those of m characters whose places begin at at: bit-parallel, after Myers and Hyyro."""
    one, zero, every = places.kind(1), places.kind(0), places.kind((1 << places.limit) - 1)
    top = one << places.held(np.maximum(m - 1, 0))
    none = places.held(np.zeros(len(m), dtype=np.int64))
    up, down, distance = none | every, none, m.astype(np.int32)
    for i in range(int(n.max(initial=0))):
        there, x = i < n, places.flat[at + a[i]] | down
        d = ((((x & up) + up) & every) ^ up) | x
        right, left = down | (every ^ (d | up)), up & d
        distance += there & ((right & top) != zero)
        distance -= there & ((left & top) != zero)
        right, left = ((right << one) | one) & every, (left << one) & every
        up, down = left | (every ^ (d | right)), right & d
    return np.where(m == 0, n, distance)


def jaro_winkler(a: np.ndarray, n: np.ndarray, places: Places, at: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """similarity.jaro_winkler of texts a and b: each character of a takes the first free place in b within the window."""
    one, zero = places.kind(1), places.kind(0)
    window = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    span = (one << places.held(2 * window + 1)) - one
    taken, found = places.held(np.zeros(len(n), dtype=np.int64)), []
    for i in range(int(n.max(initial=0))):
        here = places.flat[at + a[i]]
        free = here & ((span << places.held(np.maximum(i - window, 0))) >> places.held(np.maximum(window - i, 0))) & ~taken
        took = free & (~free + one)
        taken = taken | took
        found.append((took != zero, here))
    k, moved, rest = np.zeros(len(n), dtype=np.int32), np.zeros(len(n), dtype=np.int32), taken
    for hit, here in found:
        low = rest & (~rest + one)
        k += hit
        moved += hit & ((low & here) == zero)
        rest = np.where(hit, rest ^ low, rest)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (k / n + k / m + (k - moved / 2.0) / k) / 3.0
    same, going = np.zeros(len(n), dtype=np.int32), np.ones(len(n), dtype=bool)
    for i in range(min(4, len(a), len(b))):
        going = going & (a[i] == b[i]) & (a[i] > 0)
        same += going
    equal = (n == m) & (same >= np.minimum(n, 4))
    for i in range(4, int(np.minimum(n, m).max(initial=0))):
        equal &= a[i] == b[i]
    return np.where(equal, 1.0, np.where(k == 0, 0.0, jaro + same * 0.1 * (1.0 - jaro)))


def ratio(n: np.ndarray, m: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1.0 if both are empty, 0.0 if one is, else value."""
    return np.where((n == 0) & (m == 0), 1.0, np.where((n == 0) | (m == 0), 0.0, value))


#: What features need besides texts, their ids and lengths.
ASKS = {
    "words": ("name_token_jaccard", "name_token_dice", "name_token_overlap"), "places": ("addr_token_jaccard", "addr_token_overlap"), "numbers": ("addr_number_overlap",),
    "name_grams": ("name_3gram_jaccard",), "addr_grams": ("addr_3gram_jaccard",), "bits": ("name_jaro_winkler", "name_levenshtein"),
}


class Entities:
    """What the features named need of each row of norm_name, norm_address, country and entity_id, made once a row."""

    def __init__(self, rows: pa.Table, names: tuple[str, ...]):
        self.names = names
        self.needs = {n for n, of in ASKS.items() if set(of) & set(names)}
        text = {c: pc.fill_null(rows[c].combine_chunks(), "") for c in ("norm_name", "norm_address", "country")}
        self.same = {c: self._ids(x) for c, x in text.items()}
        name, address = text["norm_name"], text["norm_address"]
        chars, self.n, most = characters(name)
        self.sets = {}
        if "name_grams" in self.needs:
            self._set("name_grams", grams(chars, self.n, most))
        if "bits" in self.needs:
            self.chars, self.places = np.ascontiguousarray(chars.T), Places(chars, most)
        if "addr_grams" in self.needs:
            chars, self.k, most = characters(address)
            self._set("addr_grams", grams(chars, self.k, most))
        else:
            self.k = pc.utf8_length(address).to_numpy().astype(np.int32)
        if self.needs & {"words"} or "name_first_token" in names:
            words = Words(name)
            self.first = words.first()
            self._set("words", (*sets(words.rows), words.most))
        if self.needs & {"places", "numbers"}:
            words = Words(address)
            self._set("places", (*sets(words.rows), words.most))
            self._set("numbers", (*sets(words.numbers()), words.most))
        ids = rows["entity_id"].combine_chunks()
        self.of = {s: pc.starts_with(ids, s).to_numpy(zero_copy_only=False) for s in ("S2-", "S3-")}

    @staticmethod
    def _ids(text: pa.Array) -> np.ndarray:
        """A number above 0 for each text but the empty one."""
        coded = text.dictionary_encode()
        filled = np.append(pc.utf8_length(coded.dictionary).to_numpy() > 0, False)
        codes = coded.indices.to_numpy()
        return np.where(filled[codes], codes + 1, 0)

    def _set(self, name: str, made: tuple[np.ndarray, np.ndarray, int]) -> None:
        table = made[0].astype(np.uint16) if made[2] < 65_535 else made[0]
        self.sets[name] = (table, np.ascontiguousarray(table.T), made[1], made[2] + 1)

    def shared(self, name: str, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes of the sets of rows i and j, and of what they share; where few rows i have many pairs, a table holds their members."""
        table, turned, count, width = self.sets[name]
        low, high = int(i[0]), int(i[-1]) + 1
        n, m, both = count[i], count[j], np.zeros(len(i), dtype=np.int32)
        if (high - low) * width <= 16 * len(i):
            held = np.zeros((high - low, width), dtype=np.uint8)
            held[np.arange(high - low)[:, None], table[low:high]] = 1
            held[:, 0] = 0
            held, base = held.ravel(), (i - low) * width
            for k in range(int(m.max())):
                both += held[base + turned[k][j]]
        else:
            theirs = turned[: int(m.max())][:, j]
            for k in range(int(n.max()) if len(theirs) else 0):
                member = turned[k][i]
                both += np.where(member > 0, np.add.reduce(theirs == member, axis=0, dtype=np.int32), 0)
        return n, m, both

    def features(self, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        """The features named of pairs of rows; i ascends."""
        made, n, m, k, l = {}, self.n[i], self.n[j], self.k[i], self.k[j]  # noqa: E741
        met = {s: self.shared(s, i, j) for s in self.needs if s != "bits"}
        exact = lambda ids: ((ids[i] > 0) & (ids[i] == ids[j])).astype(np.float64)
        jaccard = lambda x, y, both: ratio(x, y, both / np.maximum(x + y - both, 1))
        dice = lambda x, y, both: ratio(x, y, 2.0 * both / np.maximum(x + y, 1))
        overlap = lambda x, y, both: ratio(x, y, both / np.maximum(np.minimum(x, y), 1))
        flag = lambda c: c.astype(np.float64)
        if "bits" in self.needs:
            a, b, at = self.chars[: int(n.max())][:, i], self.chars[:, j], j.astype(np.int64) * self.places.width
        longest = np.maximum(n, m)
        makers: dict[str, Callable[[], np.ndarray]] = {
            "name_exact": lambda: exact(self.same["norm_name"]), "name_token_jaccard": lambda: jaccard(*met["words"]), "name_token_dice": lambda: dice(*met["words"]), "name_token_overlap": lambda: overlap(*met["words"]),
            "name_3gram_jaccard": lambda: jaccard(*met["name_grams"]), "name_jaro_winkler": lambda: jaro_winkler(a, n, self.places, at, b, m),
            "name_levenshtein": lambda: ratio(n, m, 1.0 - levenshtein(a, n, self.places, at, m) / np.maximum(longest, 1)), "name_first_token": lambda: exact(self.first),
            "name_length_ratio": lambda: np.where(longest > 0, np.minimum(n, m) / np.maximum(longest, 1), 1.0), "name_length_diff": lambda: flag(np.abs(n - m)), "s1_name_missing": lambda: flag(n == 0), "cand_name_missing": lambda: flag(m == 0),
            "addr_exact": lambda: exact(self.same["norm_address"]), "addr_token_jaccard": lambda: jaccard(*met["places"]), "addr_token_overlap": lambda: overlap(*met["places"]), "addr_3gram_jaccard": lambda: jaccard(*met["addr_grams"]),
            "addr_number_overlap": lambda: overlap(*met["numbers"]), "addr_length_diff": lambda: flag(np.abs(k - l)), "s1_addr_missing": lambda: flag(k == 0), "cand_addr_missing": lambda: flag(l == 0), "both_addr_missing": lambda: flag((k == 0) & (l == 0)),
            "name_addr_exact": lambda: exact(self.same["norm_name"]) * exact(self.same["norm_address"]), "country_match": lambda: exact(self.same["country"]), "is_s2": lambda: flag(self.of["S2-"][j]), "is_s3": lambda: flag(self.of["S3-"][j]),
        }
        for f in self.names:
            made[f] = makers[f]()
        return made


def first_shared(group: np.ndarray, code: np.ndarray, codes: pa.Array, asked: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether the code where rows i and j meet is the first of i's that both have: only codes that some row of j's group has can come before it."""
    counts = pc.list_value_length(codes).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    numbers = codes.flatten()
    ids = numbers.dictionary_encode().indices.to_numpy() + np.int32(1)
    numbers = numbers.to_numpy()
    key = group[row] * (int(ids.max(initial=0)) + 1) + ids
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    met = numbers == code[row]
    own = np.full(len(counts), np.iinfo(np.int64).max)
    np.minimum.at(own, row[met], place[met])
    there = np.zeros(len(key), dtype=bool)
    mine = np.flatnonzero(asked[row] & (place < own[row]))
    there[mine] = pc.is_in(pa.array(key[mine]), value_set=pa.array(key[~asked[row]])).to_numpy(zero_copy_only=False)
    before = ragged(ids[there], np.bincount(row[there], minlength=len(counts)))
    theirs = ragged(ids[~asked[row]], np.where(asked, 0, counts)).T.copy()

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        good = np.ones(len(i), dtype=bool)
        for k in range(before.shape[1]):
            some = np.flatnonzero(before[i, k])
            if len(some):
                code, at = before[i[some], k], j[some]
                for held in theirs:
                    good[some] &= held[at] != code
        return good

    return test


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of ROWS rows at least, but for the last."""
    some, n = [], 0
    for batch in batches:
        some, n = [*some, batch], n + batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if n:
        yield pa.Table.from_batches(some)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that meet someone, their groups, who is asked, and where each group begins. A group that goes on has its known rows carried over."""
    carried = None
    for rows in gathered(batches):
        if carried is not None:
            rows = pa.concat_tables([carried, rows])
        rows = rows.combine_chunks()
        code, salt, asked = (rows[c].to_numpy() for c in ("code", "salt", "asked"))
        starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (salt[1:] != salt[:-1])))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
        asks = np.add.reduceat(asked.astype(np.int64), starts)
        sizes = np.diff(np.append(starts, len(code)))
        last = np.flatnonzero((group == group[-1]) & ~asked)
        carried = rows.take(last) if len(last) else None
        kept = np.flatnonzero(((asks > 0) & (asks < sizes))[group])
        if len(kept):
            yield rows.take(kept).combine_chunks(), group[kept], asked[kept], code[kept]


def pairs_of(group: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each asked row with the known ones of its group, which precede it, about PAIRS at a time."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.add.reduceat((~asked).astype(np.int64), starts)
    place = np.cumsum(np.append(0, group[1:] != group[:-1]))
    s = np.flatnonzero(asked)
    n, begin = sizes[place[s]], starts[place[s]]
    upto = np.append(0, np.cumsum(n))
    at = 0
    while at < len(s):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        count = n[at:end]
        i = np.repeat(s[at:end], count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[at:end], count)
        for k in range(0, len(i), PAIRS):
            yield i[k : k + PAIRS], j[k : k + PAIRS]
        at = end


def met(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], labelled: bool, made: Callable) -> Iterator[pa.RecordBatch]:
    """made(rows, i, j, label, features) for the pairs of rows that meet, each where the first code that both have does.

    Batches have code, salt, asked, entity_id, codes, norm_name, norm_address and country, in order of code, salt and asked.
    """
    for rows, group, asked, code in blocks(batches):
        entities = Entities(rows, names)
        label = linked(rows) if labelled else lambda i, j: None
        first = first_shared(group, code, rows["codes"].combine_chunks(), asked)
        for i, j in pairs_of(group, asked):
            good = first(i, j)
            if not good.all():
                i, j = i[good], j[good]
            if len(i):
                yield made(rows, i, j, label(i, j), entities.features(i, j))


def linked(rows: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether the links of row i have the id of row j, as 1 or 0."""
    links, ids = rows["links"].combine_chunks(), rows["entity_id"].combine_chunks().dictionary_encode()
    counts = pc.fill_null(pc.list_value_length(links), 0).to_numpy().astype(np.int64)
    found = pc.fill_null(pc.index_in(links.flatten(), ids.dictionary), -2).to_numpy().astype(np.int64) + 1
    theirs = ragged(np.where(found > 0, found, -1), counts).T.copy()
    own = ids.indices.to_numpy().astype(np.int64) + 1
    return lambda i, j: sum((x[i] == own[j] for x in theirs), np.zeros(len(i), dtype=bool)).astype(np.int32)


def listed(names: tuple[str, ...], labelled: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: s1_id, cand_id, source, label if rows have links, and the features named of the pairs that met() makes."""

    def made(rows: pa.Table, i: np.ndarray, j: np.ndarray, label: np.ndarray | None, features: dict[str, np.ndarray]) -> pa.RecordBatch:
        ids = {"s1_id": rows["entity_id"].take(pa.array(i)), "cand_id": rows["entity_id"].take(pa.array(j)), "source": rows["source"].take(pa.array(j))}
        ids = {n: c.combine_chunks() for n, c in ids.items()}
        told = {} if label is None else {"label": pa.array(label)}
        return pa.RecordBatch.from_pydict(ids | told | {f: pa.array(c) for f, c in features.items()})

    return lambda batches: met(batches, names, labelled, made)


def tallied(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of x, and the sum of n over each: told apart by a hash, which is checked."""
    bits, h = x.view(np.uint64), np.zeros(len(x), dtype=np.uint64)
    for column in bits.T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    if not np.array_equal(bits[first][place], bits):
        _, first, place = np.unique(bits, axis=0, return_index=True, return_inverse=True)
    return x[first], np.bincount(place.ravel(), weights=n)


def counted(names: tuple[str, ...], most: int = 100_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: label, the features named, and n, how many of the pairs that met() makes have these; rows may repeat."""

    def made(rows, i, j, label, features):
        return tallied(np.ascontiguousarray(np.column_stack([label.astype(np.float64), *features.values()])), np.ones(len(i)))

    def batch(x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = {"label": pa.array(x[:, 0].astype(np.int32))} | {f: pa.array(np.ascontiguousarray(c)) for f, c in zip(names, x[:, 1:].T, strict=True)}
        return pa.RecordBatch.from_pydict(columns | {"n": pa.array(n.astype(np.int64))})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for x, n in met(batches, names, True, made):
            some, held = [*some, (x, n)], held + len(x)
            if held > 2 * most:
                some = [tallied(*map(np.concatenate, zip(*some, strict=True)))]
                held = len(some[0][0])
                if held > most:
                    yield batch(*some[0])
                    some, held = [], 0
        if some:
            yield batch(*tallied(*map(np.concatenate, zip(*some, strict=True))))

    return each
