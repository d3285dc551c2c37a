"""Which of many texts stand in the texts of a table as they stand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes by which a place is first told, by which all but longer texts are told, and that are looked at at a time.
HEAD, FRONT, BLOCK = 4, 16, 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _bytes(n: int) -> np.uint64:
    """A mask of the first ``n`` bytes of eight."""
    return np.uint64((1 << 8 * max(min(n, 8), 0)) - 1)


def _once(parts: list[np.ndarray]) -> np.ndarray:
    """What stands in the parts, in order, each once."""
    every = np.sort(np.concatenate([np.zeros(0, np.int64), *parts]))
    return every[np.diff(every, prepend=-1) != 0]


def _table(fronts: list[bytes], n: int) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Looks up the first ``n`` bytes of places, given as two words of eight, among the fronts: which one it is, and whether it is one."""
    first, second = np.frombuffer(b"".join(f.ljust(FRONT, b"\0") for f in fronts), "<u8").reshape(-1, 2).T.copy()
    bits = np.uint64(64 - max(len(fronts).bit_length() + 3, 10))
    slot = lambda a, b, turn: ((a ^ (b * _SPREAD)) * (_SPREAD + np.uint64(2 * turn))) >> bits
    # Fronts that fall on the slot of another one stand in a further table.
    tables, left = [], np.arange(len(fronts))
    while len(left):
        table, at = np.zeros(1 << (64 - int(bits)), np.int32), slot(first[left], second[left], len(tables))
        table[at] = left
        tables.append(table)
        left = left[table[at] != left]

    def look(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = a & _bytes(n), b & _bytes(n - 8)
        which, held = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        for turn, table in enumerate(tables):
            k = table[slot(a, b, turn)]
            same = (first[k] == a) & (second[k] == b)
            which[same] = k[same]
            held |= same
        return which, held

    return look


def finder(wanted: list[tuple[int, str]]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Tells which ``wanted`` texts (number, text; none empty) stand in texts, given as their UTF-8 bytes one after the other and the offsets of these: (rows, numbers), each pair once.

    All places of the texts are told by a few bytes, and those that may begin a wanted text
    by the bytes of that, up to ``FRONT``; a longer one is compared with the whole text.
    So time grows with the texts and with what they hold, not with the wanted texts.
    """
    fronts: dict[int, dict[bytes, list]] = {}
    for number, text in wanted:
        own = text.encode()
        fronts.setdefault(min(len(own), FRONT), {}).setdefault(own[:FRONT], []).append((number, own if len(own) > FRONT else None))
    tables = {n: _table(list(own), n) for n, own in fronts.items()}
    keyed = [meant for own in fronts.values() for meant in own.values()]
    begins = dict(zip(fronts, np.cumsum([0, *map(len, fronts.values())]).tolist()))
    # Of each front the text that is no longer, and the fronts of longer ones.
    exact = np.array([next((number for number, whole in meant if whole is None), -1) for meant in keyed], np.int64)
    more = np.array([any(whole is not None for _, whole in meant) for meant in keyed], bool)
    bits = np.uint64(64 - min(max(16, len(wanted).bit_length() + 3), 22))
    spread = lambda words, head: ((words & _bytes(head)) * _SPREAD) >> bits
    marks = {head: np.zeros(1 << (64 - int(bits)), np.uint32) for head in {min(n, HEAD) for n in fronts}}
    for n, own in fronts.items():
        words = np.frombuffer(b"".join(f[:8].ljust(8, b"\0") for f in own), "<u8")
        marks[min(n, HEAD)][spread(words, min(n, HEAD))] |= np.uint32(1 << n)

    def block(data: np.ndarray, offsets: np.ndarray, begin: int) -> Iterator[np.ndarray]:
        n = min(BLOCK, len(data) - begin)
        part = np.zeros(n + FRONT, np.uint8)
        own = data[begin : begin + n + FRONT]
        part[: len(own)] = own
        words = np.ndarray((n + 8,), "<u8", part, 0, (1,))  # eight bytes from each place on
        for head, table in marks.items():
            mark = table[spread(words[:n], head)]
            at = np.flatnonzero(mark != 0)
            mark, first, second = mark[at], words[at], words[at + 8]
            for size in fronts:
                if min(size, HEAD) == head:
                    of = np.flatnonzero((mark & np.uint32(1 << size)) != 0)
                    key, held = tables[size](first[of], second[of])
                    place = at[of[held]] + begin
                    row = np.searchsorted(offsets, place, "right") - 1
                    whole = place + size <= offsets[row + 1]
                    yield (row * len(keyed) + key[held] + begins[size])[whole]

    def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = _once([_once(list(block(data, offsets, begin))) for begin in range(0, len(data), BLOCK)])
        row, key = np.divmod(met, max(len(keyed), 1))
        told = exact[key] >= 0
        rows, numbers, last, text = [row[told]], [exact[key[told]]], None, b""
        for r, k in zip(row[more[key]].tolist(), key[more[key]].tolist()):
            if r != last:
                last, text = r, data[offsets[r] : offsets[r + 1]].tobytes()
            found = [number for number, whole in keyed[k] if whole is not None and whole in text]
            rows.append(np.full(len(found), r, np.int64))
            numbers.append(np.array(found, np.int64))
        return np.concatenate(rows), np.concatenate(numbers)

    return find


def held(rows: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with a ``number`` of the ``wanted`` texts (number long, wanted string) in place of their ``text``, a row for each that the text holds; every task gets the wanted texts."""
    shared = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in wanted.select("number", "wanted").collect()])
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(shared.value)
        for batch in batches:
            texts = batch.column(text).cast(pa.large_binary())
            _, places, data = texts.buffers()
            offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
            row, number = find(bytes_, offsets - offsets[0])
            kept = batch.select(others).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(number, pa.int64())], names=[*others, "number"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "number long"]))
