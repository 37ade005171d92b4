"""Removal of repeated substrings by blockwise suffix sorting with a difference cover.

A window is a ``LENGTH``-byte string of a document.  Windows are put in buckets by
the least hash of the ``GRAM``-byte strings they hold, so equal windows share a
bucket and neighbouring windows mostly do.  Only buckets met twice matter; their
windows' bytes, as runs, are dealt out by bucket, and one bucket at a time is
sorted: by the first ``COVER`` bytes, and, as ties run long, by ranks of a sample of
positions.  The sample holds the residues of a difference cover modulo
``COVER``, so any two windows have an offset at which both are sampled, and one
comparison of ranks computed before settles a tie.  Windows equal to another
are removed.  No hash decides equality.

A bucket met more than ``HOT`` times, such as one of a passage that a share of all documents
holds, is split: its windows are named by a hash of all their bytes, and those whose
name is met twice are dealt out by that name, each once a block.

Documents are dealt to blocks of bounded size.  Blocks and buckets exchange arrays, by way
of relays where they are many, so a block sends at most ``FAN`` rows, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import written

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1  # gram positions of a window
COVER = 8
#: Difference cover modulo 8: every residue is a difference of two of these.
RESIDUES = (0, 1, 2, 4)
#: Bytes of documents in a block, on average, and bytes hashed or sorted at once.
BLOCK_BYTES = 8 << 20
STRETCH = 1 << 20
#: Places of one bucket above which it is split by whole windows.
HOT = 1 << 14
#: Copies of one row (id and text) that may lie in one block.
REPEATS = 256
#: Rows that a block, a relay or a bucket sends at most.
FAN = 1024
_FACTOR = 0x9E3779B97F4A7C15
_CODEC = "zstd"


def _powers(n: int):
    """Powers of the hash's factor and of its inverse modulo 2**64."""
    if _powers.n < n:
        for name, f in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
            a = np.full(n, f, np.uint64)
            a[0] = 1
            setattr(_powers, name, np.cumprod(a))
        _powers.n = n
    return _powers.up, _powers.down


_powers.n = 0


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours: of running values from
    the left and from the right in pieces of that width."""
    n = len(a) - width + 1
    rows = np.pad(a, (0, -len(a) % width), mode="edge").reshape(-1, width)
    ahead = best.accumulate(rows, axis=1).ravel()
    behind = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """64-bit hash of the ``width`` bytes at each position of ``data``."""
    n = len(data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[width:] - total[:-width]) * down[: n - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def stretches(texts: list[bytes]):
    """Yields ``(data, begin, document, offset)``: bytes of some documents one after another,
    where each segment begins in them, its document, and its place there.  Long documents
    come in stretches that overlap by a window less one, so every window is in one."""
    data, begin, document, offset, n = [], [], [], [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(0, len(t) - LENGTH + 1), STRETCH):
            part = t[a : a + STRETCH + LENGTH - 1]
            if n + len(part) > STRETCH + LENGTH and n:
                yield np.frombuffer(b"".join(data), np.uint8), np.array(begin), np.array(document), np.array(offset)
                data, begin, document, offset, n = [], [], [], [], 0
            data.append(part)
            begin.append(n)
            document.append(k)
            offset.append(a)
            n += len(part)
    if n:
        yield np.frombuffer(b"".join(data), np.uint8), np.array(begin), np.array(document), np.array(offset)


def window_runs(data: np.ndarray, begin: np.ndarray):
    """``(least, first, last, segment, hashes)``: least gram hash of runs of windows, first and last
    window of each run, its segment, and the gram hashes of all positions."""
    h = gram_hashes(data)
    least = _sliding(h, SPAN, np.minimum)
    end = np.append(begin[1:], len(data))
    segment = np.repeat(np.arange(len(begin)), end - begin)[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= end[segment]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (segment[1:] != segment[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    return least, first, last, segment[first], h


def _counted(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    value, times = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
    return value, times.astype(np.uint32)


def met(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket hashes of all windows, and at how many places of the texts each is met."""
    found = []
    for data, begin, _, _ in stretches(texts):
        least, first, _, _, h = window_runs(data, begin)
        # Positions whose gram is the least of a window: the most of the least there equals it.
        wide = np.concatenate([np.full(SPAN - 1, least[0]), least, np.full(SPAN - 1, least[-1])])
        at = np.flatnonzero(_sliding(wide, SPAN, np.maximum) == h)
        found.append(h[at])
        found.append(np.setdiff1d(least[first], h[at]))
    return _counted(found)


def _among(value: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ``names``."""
    if not len(names):
        return np.zeros(len(value), bool)
    return names[np.minimum(np.searchsorted(names, value), len(names) - 1)] == value


def windows_of(data: np.ndarray, first: np.ndarray, last: np.ndarray):
    """``(window, run, name)``: each window of the runs, its run, and the hash of all its bytes."""
    size = last - first + 1
    run = np.repeat(np.arange(len(first)), size)
    window = np.arange(len(run)) + (first - np.cumsum(size) + size)[run]
    return window, run, gram_hashes(data, LENGTH)[window]


def window_names(texts: list[bytes], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the windows of the ``hot`` buckets, and how often each is met."""
    value, times = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    for data, begin, _, _ in stretches(texts):
        least, first, last, _, _ = window_runs(data, begin)
        busy = _among(least[first], hot)
        if busy.any():
            own, n = _counted([windows_of(data, first[busy], last[busy])[2]])
            value, back = np.unique(np.concatenate([value, own]), return_inverse=True)
            times = np.bincount(back, np.concatenate([times, n])).astype(np.uint32)
    return value, times


def _alike(data: np.ndarray, window: np.ndarray, name: np.ndarray):
    """``(group, sample)``: windows of one group have equal bytes, those of ``sample``'s window."""
    order = np.argsort(name, kind="stable")
    at = window[order]
    new = np.ones(len(at), bool)
    same = name[order][1:] == name[order][:-1]
    word = _words(data)
    for k in range(0, LENGTH, 8):
        same &= word[at[1:] + k] == word[at[:-1] + k]
    new[1:] = ~same
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, at[new]


_OFFSET = np.array([[next(d for d in range(COVER) if (a + d) % COVER in RESIDUES and (b + d) % COVER in RESIDUES) for b in range(COVER)] for a in range(COVER)])
_PLACE = np.array([RESIDUES.index(r) if r in RESIDUES else -1 for r in range(COVER)])


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number, first byte highest."""
    a = text.astype(np.uint64)
    for n in (1, 2, 4):
        a = (a[:-n] << np.uint64(8 * n)) | a[n:]
    return a


def cover_ranks(word: np.ndarray) -> np.ndarray:
    """Ranks of the ``LENGTH - COVER`` bytes at each sampled position, by doubling: a
    sampled position moved by a multiple of ``COVER`` is sampled again."""
    per = len(RESIDUES)
    whole = len(word) // COVER * COVER
    sample = word[:whole].reshape(-1, COVER)[:, RESIDUES].ravel()
    rank = {COVER: np.unique(sample, return_inverse=True)[1].astype(np.int64)}

    def paired(a: int, b: int) -> None:
        later = np.full(len(sample), -1, np.int64)  # past the end
        by = a // COVER * per
        later[: max(0, len(sample) - by)] = rank[b][by:]
        rank[a + b] = np.unique(rank[a] * (len(sample) + 1) + later + 1, return_inverse=True)[1].astype(np.int64)

    for n in (8, 16, 32, 64):
        paired(n, n)
    paired(128, 64)
    return rank[LENGTH - COVER]


def repeated_windows(text: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each window start, whether its bytes equal those of another start.

    Sorts the windows by their first bytes, then parts the ties around pivots, all
    ties at once: by cover-sample rank at the pair's common offset, then the last bytes.
    """
    word = _words(np.concatenate([text, np.zeros(2 * COVER, np.uint8)]))
    rank, per = cover_ranks(word), len(RESIDUES)
    twice = np.zeros(len(windows), bool)
    order = np.argsort(word[windows], kind="stable")
    key = word[windows[order]]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    while len(order):
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(group)))
        tied = np.repeat(size > 1, size)
        order, group = order[tied], group[tied]
        if not len(order):
            break
        size = size[size > 1]
        start = np.cumsum(size) - size
        pivot = np.repeat(windows[order[start + size // 2]], size)
        own = windows[order]
        d = _OFFSET[own % COVER, pivot % COVER]
        mine, its = ((p + d) // COVER * per + _PLACE[(p + d) % COVER] for p in (own, pivot))
        side = np.sign(rank[mine] - rank[its])
        tail, its_tail = word[own + LENGTH - COVER], word[pivot + LENGTH - COVER]
        side = np.where(side != 0, side, (tail > its_tail).astype(np.int64) - (tail < its_tail))
        equal = side == 0
        n_equal = np.add.reduceat(equal, start)
        twice[order[equal & np.repeat(n_equal > 1, size)]] = True
        # Equal windows are in place; the sides go on.
        rest = np.flatnonzero(~equal)
        deal = np.lexsort((side[rest], np.repeat(np.arange(len(size)), size)[rest]))
        rest = rest[deal]
        group = 2 * np.repeat(np.arange(len(size)), size)[rest] + (side[rest] > 0)
        order = order[rest]
    return twice


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join([np.array([a.nbytes for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpacked(blob: bytes, *types) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec=_CODEC, asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for n, t in zip(sizes, types):
        out.append(np.frombuffer(raw[at : at + n], t))
        at += n
    return out


def _dealt(bucket: np.ndarray):
    """``(bucket, indices)`` for each bucket."""
    order = np.argsort(bucket, kind="stable")
    value, first = np.unique(bucket[order], return_index=True)
    return zip(value.tolist(), np.split(order, first[1:]))


def hops(n: int, fan: int = FAN) -> tuple[int, list[int]]:
    """``(base, widths)``: an exchange among ``n`` places in hops, the k-th to a range of
    ``widths[k]`` targets, the last to one.  A sender or relay reaches ``base`` ranges, at most ``fan``.
    """
    count = 1
    while max(2, fan) ** count < n:
        count += 1
    base = max(1, round(n ** (1 / count)) - 1)
    while base**count < n:
        base += 1
    return base, [base**k for k in reversed(range(count))]


def _columns(blobs: list[bytes], width: int) -> np.ndarray:
    """The packets of :func:`_deal_columns` as one array, a row for each field."""
    return np.concatenate([np.zeros((width, 0), np.int64), *(_unpacked(x, np.int64)[0].reshape(width, -1) for x in blobs)], axis=1)


def _deal_columns(items: np.ndarray, target: np.ndarray):
    """``(target, packet)``: the columns of ``items`` by target."""
    for t, i in _dealt(target):
        yield t, _packed(items[:, i].ravel())


#: Of a run: bucket's name, bytes, places, whether it is known to repeat; of a place: block, document, offset; all bytes.
_RUNS = (np.uint64, np.int64, np.int64, np.bool_, np.int64, np.int64, np.int64, np.uint8)


def _runs(blobs: list[bytes]) -> list[np.ndarray]:
    """The packets of :func:`_deal_runs` as one set of arrays."""
    return [np.concatenate(x) for x in zip(*(_unpacked(b, *_RUNS) for b in blobs))]


def _deal_runs(items, target: np.ndarray):
    """``(target, packet)``: runs with their places and bytes by target."""
    name, size, times, sure, block, document, place, data = items
    raw, stop, last = data.tobytes(), np.cumsum(size), np.cumsum(times)
    for t, i in _dealt(target):
        n = times[i]
        at = np.repeat(last[i] - np.cumsum(n), n) + np.arange(int(n.sum()))
        part = b"".join([raw[a:b] for a, b in zip((stop[i] - size[i]).tolist(), stop[i].tolist())])
        yield t, _packed(name[i], size[i], n, sure[i], block[at], document[at], place[at], np.frombuffer(part, np.uint8))


def _in_order(table):
    """Rows of a block in an order that each reading of it agrees on."""
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("body", "ascending")]))


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", block_bytes: int = BLOCK_BYTES, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, spans, kept``.

    ``spans`` are the maximal removed byte ranges ``(start, end)`` of the UTF-8 text (null:
    empty): the union of all ``LENGTH``-byte strings that also start at another
    place, in any document, judged on the input.  ``kept`` are the bytes left,
    which may part a character.  Texts are read whole, however long.  Rows that repeat are documents of their own, so
    they remove each other where long enough.  Other columns are ignored; an empty
    table gives an empty result.  A task holds one block of documents, or the runs of
    the buckets dealt to it, equal runs once.  Of a bucket met at more than ``hot`` places
    a block sends each different window once, dealt out by all its bytes, and only windows
    whose hash another place has; places of windows that repeat within the block are not sent.
    Blocks and buckets are as many; up to ``fan`` of them exchange rows
    directly, more of them in hops (see :func:`hops`).  A relay holds what one range of senders has for
    one range of targets, about a block's share, so each exchange has at most ``fan``
    rows a block and its rows grow with the text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    sizes = rows.groupBy("doc_id", F.xxhash64("body").alias("h")).agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("b"))
    total, copies = sizes.agg(F.sum("b"), F.max("n")).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-(total or 0) // block_bytes))
    own = ["doc_id", "body"]
    if (copies or 0) > REPEATS:  # one row many times: numbered, so that its copies part
        rows = written(rows.withColumn("copy", F.monotonically_increasing_id()), "numbered")
        own.append("copy")
    rows = rows.select("doc_id", "body", F.pmod(F.xxhash64(*own), F.lit(n)).alias("block"))

    base, widths = hops(n, fan)
    packet, packet_or_own = "to bigint, part bigint, data binary", "to bigint, part bigint, data binary, own binary"

    def rows_of(parts, own=False):
        types = {"to": pa.int64(), "part": pa.int64(), "data": pa.binary(), **({"own": pa.binary()} if own else {})}
        return pa.table([pa.array(c, t) for c, t in zip(zip(*parts) if parts else [[]] * len(types), types.values())], list(types))

    def sent(items, target, source):
        """Rows of a sender: the range of the target, that of the source, and the items."""
        return [(t, source // base, blob) for t, blob in _deal_columns(items, target // widths[0])]

    def through(sends, fields, target):
        """The rows of ``sends`` at their targets, ``target`` of the items."""

        def relay(width):
            def deal(table):
                items, part = _columns(table["data"].to_pylist(), fields), table["part"][0].as_py()
                return rows_of([(t, part // base, blob) for t, blob in _deal_columns(items, target(items) // width)])

            return deal

        for width in widths[1:]:
            sends = sends.groupBy("to", "part").applyInArrow(relay(width), packet)
        return sends

    def by_hash(items):
        return (items[0].view(np.uint64) % np.uint64(n)).astype(np.int64)

    def tallied(block, value, times):
        items = np.stack([value.view(np.int64), np.full(len(value), block), times.astype(np.int64)])
        return rows_of(sent(items, by_hash(items), block))

    def names_in(replies, busy=False):
        """The hashes of replies, sorted; only those of busy buckets."""
        value, _, often = _columns(replies["data"].to_pylist(), 3)
        return np.sort((value[often > 0] if busy else value).view(np.uint64))

    def meet(table):
        return tallied(table["block"][0].as_py(), *met(table["body"].to_pylist()))

    def meet_windows(table, replies):
        busy = names_in(replies, True)
        if not table.num_rows or not len(busy):
            return rows_of([])
        return tallied(table["block"][0].as_py(), *window_names(table["body"].to_pylist(), busy))

    def common(table):
        value, block, times = _columns(table["data"].to_pylist(), 3)
        _, back = np.unique(value, return_inverse=True)
        total = np.bincount(back, times)[back]
        items = np.stack([value, block, total > hot])[:, total > 1]
        return rows_of(sent(items, items[1], table["to"][0].as_py()))

    def runs(table, replies):
        if not table.num_rows or not replies.num_rows:
            return rows_of([], True)
        table = _in_order(table)
        whole = replies["whole"].combine_chunks()
        buckets = replies.filter(pc.invert(whole))
        busy, wanted_windows = names_in(buckets, True), names_in(replies.filter(whole))
        wanted = np.setdiff1d(names_in(buckets), busy)
        index_of, samples, titles, told = {}, [], [], []  # windows of split buckets
        name, document, place, index, texts = [], [], [], {}, []
        which = []
        for data, begin, docs_of, offset in stretches(table["body"].to_pylist()):
            least, first, last, segment, _ = window_runs(data, begin)
            value = least[first]
            hit, split = np.flatnonzero(_among(value, wanted)), np.flatnonzero(_among(value, busy))
            raw = data.tobytes()
            if len(split):
                window, run, title = windows_of(data, first[split], last[split])
                some = _among(title, wanted_windows)
                window, run, title = window[some], segment[split][run[some]], title[some]
                group, sample = _alike(data, window, title)
                ks = np.array([index_of.setdefault(raw[a : a + LENGTH], len(index_of)) for a in sample.tolist()], np.int64)
                fresh = ks >= len(samples)  # in order of their first sight
                order = np.unique(ks[fresh], return_index=True)[1]
                samples += [raw[a : a + LENGTH] for a in sample[fresh][order].tolist()]
                titles.append(gram_hashes(data, LENGTH)[sample[fresh][order]])
                told.append(np.stack([ks[group], docs_of[run], window - begin[run] + offset[run]]))
            for a, b, v in zip(first[hit].tolist(), last[hit].tolist(), value[hit].tolist()):
                text = raw[a : b + LENGTH]
                k = index.setdefault(text, len(texts))
                if k == len(texts):
                    texts.append(text)
                    name.append(v)
                which.append(k)
            document.append(docs_of[segment[hit]])
            place.append(first[hit] - begin[segment[hit]] + offset[segment[hit]])
        out, block, sure = [], table["block"][0].as_py(), np.zeros(len(texts), bool)
        if samples:
            k, doc, at = np.concatenate(told, axis=1)
            again = np.bincount(k) > 1  # known to repeat: only the bytes go out
            single = ~again[k]
            which, sure = which + (k[single] + len(texts)).tolist(), np.concatenate([sure, again])
            document.append(doc[single])
            place.append(at[single])
            name, texts = name + np.concatenate(titles).tolist(), texts + samples
            doc, at = doc[~single], at[~single]
            if len(doc):
                order = np.lexsort((at, doc))
                doc, at = doc[order], at[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))
                spans = np.stack([doc[new], at[new], at[np.append(new[1:], len(at)) - 1] + LENGTH], axis=1)
                items = np.concatenate([np.full((1, len(spans)), block), spans.T])
                out.append((block // widths[0], block // base, None, _packed(items.astype(np.int64).ravel())))
        if not texts:
            return rows_of(out, True)
        name, which = np.array(name, np.uint64), np.array(which, np.int64)
        document, place = np.concatenate(document).astype(np.int64), np.concatenate(place).astype(np.int64)
        by_run = np.argsort(which, kind="stable")
        size, times = np.array([len(t) for t in texts]), np.bincount(which, minlength=len(texts))
        items = (name, size, times, sure, np.full(len(which), block), document[by_run], place[by_run], np.frombuffer(b"".join(texts), np.uint8))
        out += [(t, block // base, blob, None) for t, blob in _deal_runs(items, by_hash(items) // widths[0])]
        return rows_of(out, True)

    def through_runs(sends):
        def relay(width):
            def deal(table):
                part, runs = table["part"][0].as_py() // base, table["data"].drop_null().to_pylist()
                own = table["own"].drop_null().to_pylist()
                out = [(int(_columns([x], 4)[0, 0]) // width, part, None, x) for x in own]
                if runs:
                    items = _runs(runs)
                    out += [(t, part, blob, None) for t, blob in _deal_runs(items, by_hash(items) // width)]
                return rows_of(out, True)

            return deal

        for width in widths[1:]:
            sends = sends.groupBy("to", "part").applyInArrow(relay(width), packet_or_own)
        return sends

    def sort_bucket(table):
        index, texts, names, bucket = {}, [], [], table["to"][0].as_py()
        done = _columns(table["own"].drop_null().to_pylist(), 4)
        table = table.filter(table["data"].is_valid())
        if not table.num_rows:
            return rows_of(sent(done, done[0], bucket))
        name, size, times, sure, of_block, document, place, data = _runs(table["data"].to_pylist())
        raw, stop, ks = data.tobytes(), np.cumsum(size), []
        for v, a, b in zip(name.tolist(), (stop - size).tolist(), stop.tolist()):
            text = raw[a:b]
            k = index.setdefault(text, len(texts))
            if k == len(texts):
                texts.append(text)
                names.append(v)
            ks.append(k)
        which, known = np.repeat(ks, times), np.array(ks)[sure]
        often = np.bincount(which, minlength=len(texts)) > 1
        often[known] = True
        size = np.array([len(t) for t in texts])
        order = np.argsort(np.array(names, np.uint64), kind="stable")
        # Sort as many buckets at a time as stay within a stretch.
        sorted_names = np.array(names, np.uint64)[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]]))
        spans = [None] * len(texts)
        group, n_bytes = [], 0
        for a, b in zip(edge, np.append(edge[1:], len(order))):
            group.append(order[a:b])
            n_bytes += int(size[order[a:b]].sum())
            if n_bytes >= STRETCH or b == len(order):
                some = np.concatenate(group)
                text = np.frombuffer(b"".join([texts[k] for k in some]), np.uint8)
                start = np.cumsum(size[some]) - size[some]
                count = size[some] - LENGTH + 1
                first = np.cumsum(count) - count
                windows = np.repeat(start - first, count) + np.arange(int(count.sum()))
                mark = repeated_windows(text, windows) | np.repeat(often[some], count)
                step = np.diff(np.concatenate([[0], mark.astype(np.int8)]))
                step[first] = mark[first]  # runs of marks end with their text
                begin = np.flatnonzero(step == 1)
                last = np.ones(len(mark), bool)
                last[:-1] = ~mark[1:]
                last[first[1:] - 1] = True
                end = np.flatnonzero(mark & last)
                owner = np.searchsorted(first, begin, "right") - 1
                for o, s, e in zip(owner.tolist(), (begin - first[owner]).tolist(), (end - first[owner]).tolist()):
                    k = some[o]
                    spans[k] = (spans[k] or []) + [(s, e + LENGTH)]
                group, n_bytes = [], 0
        counts = np.array([len(s or ()) for s in spans])
        flat = np.array([x for s in spans if s for x in s], np.int64).reshape(-1, 2)
        base = np.cumsum(counts) - counts
        times = counts[which]
        at = np.repeat(np.arange(len(which)), times)
        pick = np.repeat(base[which] - (np.cumsum(times) - times), times) + np.arange(len(at))
        found = np.stack([of_block[at], document[at], flat[pick, 0] + place[at], flat[pick, 1] + place[at]])
        found = np.concatenate([done, found], axis=1)
        return rows_of(sent(found, found[0], bucket))

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(table, replies):
        table = _in_order(table)
        bodies = table["body"].to_pylist()
        found = _columns(replies["data"].to_pylist(), 4)[1:].T
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        own = np.split(found[:, 1:], np.searchsorted(found[:, 0], np.arange(1, len(bodies))))
        spans, kept = [], []
        for body, s in zip(bodies, own):
            merged = []
            if len(s):
                reach = np.maximum.accumulate(s[:, 1])
                new = np.flatnonzero(np.concatenate([[True], s[1:, 0] > reach[:-1]]))
                merged = list(zip(s[new, 0].tolist(), reach[np.append(new[1:], len(s)) - 1].tolist()))
            spans.append([{"start": a, "end": b} for a, b in merged])
            kept.append(b"".join(body[a:b] for a, b in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(body)])))
        return pa.table([table["doc_id"], pa.array([len(b) for b in bodies], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    by_block = rows.groupBy("block")
    def meeting(tallies):
        """What the buckets of ``tallies`` reply to the blocks."""
        sends = through(tallies, 3, by_hash).groupBy("to").applyInArrow(common, packet)
        return through(sends, 3, lambda items: items[1]).withColumnRenamed("to", "block")

    shared = meeting(by_block.applyInArrow(meet, packet))
    windows = meeting(by_block.cogroup(shared.groupBy("block")).applyInArrow(meet_windows, packet))
    replies = shared.withColumn("whole", F.lit(False)).unionByName(windows.withColumn("whole", F.lit(True)))
    dealt = through_runs(by_block.cogroup(replies.groupBy("block")).applyInArrow(runs, packet_or_own))
    found = through(dealt.groupBy("to").applyInArrow(sort_bucket, packet), 4, lambda items: items[0]).withColumnRenamed("to", "block")
    out = rows.select("doc_id", F.lit(0).cast("bigint").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(b"").alias("kept")).schema
    return by_block.cogroup(found.groupBy("block")).applyInArrow(cut, out)


def digest(done: DataFrame) -> DataFrame:
    """The digest of the contract of :func:`remove_repeats`."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
