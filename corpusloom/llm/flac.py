"""Media columns: lossless FLAC of 8-bit samples, with Rice coded residuals of linear predictors.

Writing: payload bytes become signed samples; each block of ``BLOCK`` samples is one frame, coded as a constant, verbatim, or by a
linear predictor of ``ORDER`` taps fitted to the block, whose residuals are Rice coded. Every stream has a seek table.

Reading: frames are found from the stream's metadata and frame by frame; both checksums of each frame are verified, residuals and
predictors are undone, and PCM blocks come out with the sample offset and the byte offset of their frame. The reader takes
constant, verbatim, fixed and linear subframes, wasted bits, escaped partitions and both Rice methods, for one channel.

Numpy works on all frames of a batch at once: a step handles the same sample (or byte) of every frame. Batches are cut at
``TOGETHER`` bytes, so memory is bounded except for one payload that is longer.

Defined cases: a null or empty text is stored as 64 zero bytes; equal texts give equal values; every row is returned; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.texts import map_rows, sha256

BLOCK, ORDER, PRECISION, RATE = 512, 4, 10, 8000
#: Frames between two seek points; a reader works on all seek points of a batch at once.
SEEK_EVERY = 1
TOGETHER = 1 << 21
MOST_RICE = 14


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc & top else crc << 1) & mask
        table.append(crc)
    return np.array(table, dtype=np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


def crc16_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:start + size] for each row, all rows a byte a step."""
    order = np.argsort(-size, kind="stable")
    start, ordered = start[order], size[order]
    crc = np.zeros(len(order), dtype=np.uint16)
    live = len(order)
    for t in range(int(ordered[0]) if len(order) else 0):
        while live and ordered[live - 1] <= t:
            live = int(np.searchsorted(-ordered, -t, side="left"))
        c = crc[:live]
        crc[:live] = (c << np.uint16(8)) ^ CRC16[(c >> np.uint16(8)) ^ data[start[:live] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """The frame number in the variable length code of frame headers."""
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    lead = (0xFF00 >> size & 0xFF) | n >> 6 * (size - 1)
    return bytes([lead, *(0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1))])


# ---- writing


def _predictors(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients [frames, ORDER] and shifts, by autocorrelation and the Levinson-Durbin recursion."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, : f.shape[1] - k] * f[:, k:]).sum(axis=1) for k in range(ORDER + 1)], axis=1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), ORDER))
    error = r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        turned = a[:, :i][:, ::-1].copy()
        a[:, :i] -= k[:, None] * turned
        a[:, i] = k
        error *= 1 - k * k
        error = np.maximum(error, 1e-12)
    most = np.abs(a).max(axis=1)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(most, 1e-12))).astype(np.int64), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64), shift


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (none may be empty)."""
    raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    lengths = np.array([len(p) for p in payloads])
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), blocks)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = (np.cumsum(lengths) - lengths)[owner] + turn * BLOCK
    size = np.minimum(BLOCK, lengths[owner] - turn * BLOCK)
    place = np.arange(BLOCK)
    inside = place[None] < size[:, None]
    x = np.where(inside, raw[np.minimum(start[:, None] + place, len(raw) - 1)].astype(np.int64) - 128, 0)

    taps, shift = _predictors(x, size)
    guess = np.zeros_like(x[:, ORDER:])
    for j in range(ORDER):
        guess += taps[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    residual = x[:, ORDER:] - (guess >> shift[:, None])
    folded = np.where(inside[:, ORDER:], residual << 1 ^ residual >> 63, 0)
    n = np.maximum(size - ORDER, 1)
    rice = np.clip(np.floor(np.log2(np.maximum(folded.sum(axis=1) / n * 0.7, 1))).astype(np.int64), 0, MOST_RICE)
    quotient = folded >> rice[:, None]
    widths = np.where(inside[:, ORDER:], quotient + 1 + rice[:, None], 0)
    side = 8 * ORDER + 4 + 5 + ORDER * PRECISION + 6 + 4
    coded = side + widths.sum(axis=1)
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)
    linear = ~constant & (coded < 8 * size) & (size > ORDER)
    verbatim = ~constant & ~linear

    headers = []
    for t, s in zip(turn.tolist(), size.tolist(), strict=True):
        short = s != BLOCK
        head = b"\xff\xf8" + bytes([(0x70 if short else 0x90) | 0x04, 0x02]) + _coded_number(t) + (struct.pack(">H", s - 1) if short else b"")
        headers.append(head + bytes([crc8(head)]))
    head_size = np.array([len(h) for h in headers])
    body_bits = 8 + np.where(constant, 8, np.where(verbatim, 8 * size, coded))
    body = -(-body_bits // 8)
    total = head_size + body + 2
    first = np.cumsum(total) - total
    bits = np.zeros(8 * int(total.sum()), dtype=np.uint8)
    at = 8 * (first + head_size)
    kind = np.where(constant, 0, np.where(verbatim, 1, 0x20 | (ORDER - 1)))
    _put(bits, at, kind << 1, 8)
    at = at + 8
    sample = x & 0xFF
    _put(bits, at[constant], sample[constant, 0], 8)
    rows, cols = np.nonzero(inside & verbatim[:, None])
    _put(bits, at[rows] + 8 * cols, sample[rows, cols], 8)
    for j in range(ORDER):
        _put(bits, at[linear] + 8 * j, sample[linear, j], 8)
    here = at[linear] + 8 * ORDER
    _put(bits, here, np.full(len(here), PRECISION - 1), 4)
    _put(bits, here + 4, shift[linear], 5)
    for j in range(ORDER):
        _put(bits, here + 9 + j * PRECISION, taps[linear, j] & ((1 << PRECISION) - 1), PRECISION)
    here = here + 9 + ORDER * PRECISION + 6  # Rice method 0 and one partition are zero bits
    _put(bits, here, rice[linear], 4)
    offset = (here + 4)[:, None] + np.cumsum(widths[linear], axis=1) - widths[linear]
    mask = inside[linear][:, ORDER:]
    stop = offset + quotient[linear]
    bits[stop[mask]] = 1
    param = np.broadcast_to(rice[linear][:, None], mask.shape)
    low = folded[linear]
    for j in range(int(rice[linear].max(initial=0))):
        some = mask & (j < param)
        bits[stop[some] + 1 + j] = low[some] >> (param[some] - 1 - j) & 1
    data = np.packbits(bits)
    joined = np.frombuffer(b"".join(headers), dtype=np.uint8)
    spread = np.arange(len(joined)) - np.repeat(np.cumsum(head_size) - head_size, head_size) + np.repeat(first, head_size)
    data[spread] = joined
    crc = crc16_rows(data, first, total - 2)
    data[first + total - 2], data[first + total - 1] = crc >> 8, crc & 0xFF

    streams, frame = [], 0
    for payload, count in zip(payloads, blocks.tolist(), strict=True):
        offsets = first[frame : frame + count] - first[frame]
        sizes = total[frame : frame + count]
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), int(size[frame + i])) for i in range(0, count, SEEK_EVERY))
        signed = (np.frombuffer(payload, dtype=np.uint8) - np.uint8(128)).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        meta = b"fLaC" + struct.pack(">I", len(info)) + info + struct.pack(">I", 0x83000000 | len(points)) + points
        streams.append(meta + data[first[frame] : first[frame] + int(sizes.sum())].tobytes())
        frame += count
    return streams


# ---- reading


class Broken(ValueError):
    """A stream that doesn't follow the format or fails a check."""


def metadata(stream: bytes) -> tuple[int, dict[str, int | bytes], list[tuple[int, int, int]]]:
    """Where frames start, the stream's facts, and its seek points."""
    if stream[:4] != b"fLaC":
        raise Broken("no FLAC stream")
    at, facts, points, last = 4, {}, [], False
    while not last:
        head = struct.unpack_from(">I", stream, at)[0]
        last, kind, size = head >> 31, head >> 24 & 0x7F, head & 0xFFFFFF
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            facts = {"block": struct.unpack_from(">H", block)[0], "bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34]}
        elif kind == 3:
            points = list(struct.iter_unpack(">QQH", block))
        at += 4 + size
    if facts.get("channels") != 1 or facts.get("bits") != 8:
        raise Broken("not one channel of 8 bits")
    return at, facts, points


def _frame_header(data: bytes, at: int) -> tuple[int, int]:
    """Size of the header and samples of the frame at ``at``; the header's checksum is verified."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise Broken("no frame")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    lead, here = data[at + 4], at + 4
    more = 0 if lead < 0x80 else next(i for i in range(1, 8) if not lead << i & 0x80) - 1
    here += 1 + more
    if code == 6:
        samples, here = data[here] + 1, here + 1
    elif code == 7:
        samples, here = (data[here] << 8 | data[here + 1]) + 1, here + 2
    else:
        samples = 192 if code == 1 else 576 << (code - 2) if code <= 5 else 256 << (code - 8)
    here += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:here]) != data[here]:
        raise Broken("header checksum")
    return here + 1 - at, samples


class _Bits:
    """A byte array read at many bit positions at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.int64)
        n = len(data) + 1
        self.window = padded[:n] << 24 | padded[1 : n + 1] << 16 | padded[2 : n + 2] << 8 | padded[3 : n + 3]  # 32 bits from each byte
        self.data = data
        self.ones: np.ndarray | None = None

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Up to 24 bits from each position."""
        return self.window[at >> 3] >> (32 - (at & 7) - width) & (1 << width) - 1

    def next_one(self, at: np.ndarray) -> np.ndarray:
        """Position of the first set bit from each position on."""
        word = self.window[at >> 3] & (1 << (32 - (at & 7))) - 1
        found = (at & ~7) + 32 - np.frexp(word.astype(np.float64))[1]
        if (far := np.flatnonzero(word == 0)).size:
            if self.ones is None:
                self.ones = np.flatnonzero(np.unpackbits(self.data))
            found[far] = self.ones[np.minimum(np.searchsorted(self.ones, at[far]), len(self.ones) - 1)]
        return found


def _signed(value: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    half = np.left_shift(1, np.maximum(np.asarray(width) - 1, 0))
    return np.where(value >= half, value - 2 * half, value)


def decode_many(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Samples of each stream, and for each block its first sample, number of samples and the byte where its frame starts.

    A stretch runs from one seek point to the next (or is the whole stream). All stretches advance together, a frame a round."""
    data = b"".join(streams)
    facts_of, stretches, base = [], [], 0
    for i, stream in enumerate(streams):
        first, facts, points = metadata(stream)
        facts_of.append(facts)
        known = sorted({(0, 0), *((sample, offset) for sample, offset, _ in points if sample < facts["samples"])})
        ends = [base + first + offset for _, offset in known[1:]] + [base + len(stream)]
        stretches += [(i, base + first + offset, end, sample) for (sample, offset), end in zip(known, ends, strict=True)]
        base += len(stream)
    owner, at, end, place = (np.array(x, dtype=np.int64) for x in zip(*stretches, strict=True))
    raw = np.frombuffer(data, dtype=np.uint8)
    bits = _Bits(raw)
    lengths = np.array([f["samples"] for f in facts_of], dtype=np.int64)
    origin = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), dtype=np.int64)
    frames = []
    live = np.flatnonzero(at < end)
    while len(live):
        parsed = np.array([_frame_header(data, p) for p in at[live].tolist()], dtype=np.int64)
        head, size = parsed[:, 0], parsed[:, 1]
        values, after = _subframes(bits, 8 * (at[live] + head), size)
        finish = -(-after // 8)
        if (place[live] + size > lengths[owner[live]]).any() or (finish + 2 > end[live]).any():
            raise Broken("frames beyond the stream")
        inside = np.arange(values.shape[1])[None] < size[:, None]
        out[(origin[owner[live]] + place[live])[:, None][inside[:, :1]].repeat(size) + np.nonzero(inside)[1]] = values[inside]
        frames.append(np.stack([owner[live], place[live], size, at[live], finish], axis=1))
        place[live] += size
        at[live] = finish + 2
        live = live[at[live] < end[live]]
    frames = np.concatenate(frames)
    begin, length = frames[:, 3], frames[:, 4] - frames[:, 3]
    told = raw[begin + length].astype(np.int64) << 8 | raw[begin + length + 1]
    if (crc16_rows(raw, begin, length) != told).any():
        raise Broken("frame checksum")
    frames = frames[np.lexsort((frames[:, 1], frames[:, 0]))]
    if (np.bincount(frames[:, 0], weights=frames[:, 2], minlength=len(streams)) != lengths).any():
        raise Broken("samples are missing")
    starts = np.cumsum([0, *map(len, streams)])
    found, row = [], 0
    counts = np.bincount(frames[:, 0], minlength=len(streams))
    for i, facts in enumerate(facts_of):
        x = out[origin[i] : origin[i] + lengths[i]]
        if hashlib.md5(x.astype(np.int8).tobytes()).digest() != facts["md5"]:
            raise Broken("stream checksum")
        of = frames[row : row + counts[i]]
        row += counts[i]
        found.append((x, list(zip(of[:, 1].tolist(), of[:, 2].tolist(), (of[:, 3] - starts[i]).tolist(), strict=True))))
    return found


#: Coefficients of the fixed predictors by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframes(bits: _Bits, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples [frames, most samples] of the subframes at bit positions ``at``, and where each ends."""
    x = np.zeros((len(at), int(size.max())), dtype=np.int64)
    kind = bits.read(at, 8)
    at = at + 8
    wasted = np.zeros(len(at), dtype=np.int64)
    if (some := np.flatnonzero(kind & 1)).size:
        one = bits.next_one(at[some])
        wasted[some] = one - at[some] + 1
        at[some] = one + 1
    kind = kind >> 1
    width = 8 - wasted
    rows = np.flatnonzero(kind == 0)
    x[rows] = _signed(bits.read(at[rows], width[rows]), width[rows])[:, None]
    at[rows] += width[rows]
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        t = np.arange(x.shape[1])
        inside = t[None] < size[rows][:, None]
        r, c = np.nonzero(inside)
        w = width[rows][r]
        x[rows[r], c] = _signed(bits.read(at[rows][r] + c * w, w), w)
        at[rows] += size[rows] * width[rows]
    predicted = kind >= 8
    linear = kind >= 32
    order = np.where(linear, (kind & 31) + 1, kind & 7)
    for is_linear in (False, True):
        for o in np.unique(order[predicted & (linear == is_linear)]).tolist():
            rows = np.flatnonzero(predicted & (linear == is_linear) & (order == o))
            rows = rows[np.argsort(-size[rows], kind="stable")]
            values, after = _predicted(bits, at[rows], size[rows], width[rows], o, is_linear)
            x[rows, : values.shape[1]] = values
            at[rows] = after
    return x << wasted[:, None], at


def _predicted(bits: _Bits, at: np.ndarray, size: np.ndarray, width: np.ndarray, order: int, linear: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subframes with a predictor of one order, longest first."""
    n, most = len(at), int(size[0])
    x = np.zeros((most, n), dtype=np.int64)
    at = at.copy()
    for t in range(order):
        x[t] = _signed(bits.read(at, width), width)
        at += width
    taps = np.zeros((order, n), dtype=np.int64)
    shift = np.zeros(n, dtype=np.int64)
    if linear:
        precision = bits.read(at, 4) + 1
        shift = _signed(bits.read(at + 4, 5), 5)
        at += 9
        for t in range(order):
            taps[t] = _signed(bits.read(at, precision), precision)
            at += precision
    else:
        taps[:] = np.array(FIXED[order], dtype=np.int64)[:, None]
    head = bits.read(at, 6)
    at += 6
    field = np.where(head >> 4 == 1, 5, 4)
    part = size >> (head & 15)
    begins = {order} | {t for p, s in set(zip(part.tolist(), size.tolist(), strict=True)) if p < s for t in range(p, s, p)}
    rice, escaped = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    m = n
    for t in range(order, most):
        while size[m - 1] <= t:
            m -= 1
        if t in begins:
            b = np.flatnonzero((t == order) | (t % part[:m] == 0))
            rice[b] = bits.read(at[b], field[b])
            at[b] += field[b]
            escaped[b] = rice[b] == (1 << field[b]) - 1
            if (e := b[escaped[b]]).size:
                rice[e] = bits.read(at[e], 5)
                at[e] += 5
        p, k = at[:m], rice[:m]
        one = bits.next_one(p)
        folded = one - p << k | bits.read(one + 1, k)
        after = one + 1 + k
        residual = folded >> 1 ^ -(folded & 1)
        if escaped[:m].any():
            e = np.flatnonzero(escaped[:m])
            residual[e] = _signed(bits.read(p[e], k[e]), k[e])
            after[e] = p[e] + k[e]
        at[:m] = after
        guess = taps[0, :m] * x[t - 1, :m] if order else np.zeros(m, dtype=np.int64)
        for j in range(1, order):
            guess += taps[j, :m] * x[t - 1 - j, :m]
        x[t, :m] = residual + (guess >> shift[:m])
    return x.T, at


# ---- columns


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (64 if not data else 0))


def features(samples: np.ndarray) -> str:
    """Peak, mean power, zero crossings and silent samples."""
    crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
    return f"peak={int(np.abs(samples).max())};power={int((samples * samples).sum()) // len(samples)};crossings={crossings};silent={int((samples == -128).sum())}"


def _groups(payloads: list[bytes]) -> list[slice]:
    out, start, held = [], 0, 0
    for i, p in enumerate(payloads):
        if held and held + len(p) > TOGETHER:
            out.append(slice(start, i))
            start, held = i, 0
        held += len(p)
    return [*out, slice(start, len(payloads))] if payloads else []


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media, the FLAC stream of each text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(cols: dict[str, list]) -> dict[str, list]:
        payloads = [payload_of(t) for t in cols["text"]]
        media = [m for part in _groups(payloads) for m in encode_many(payloads[part])]
        return {"doc_id": cols["doc_id"], "n_bytes": [len((t or "").encode()) for t in cols["text"]], "media": media}

    return map_rows(docs.select("doc_id", "text"), run, schema)


def read_media(media: DataFrame) -> DataFrame:
    """What the stored streams hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, n_blocks."""
    schema = T.StructType(
        [
            media.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
            T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("n_blocks", T.LongType()),
        ]
    )

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema.fields} | {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"]}
        streams = cols["media"]
        for part in _groups(streams):
            for stream, (samples, blocks) in zip(streams[part], decode_many(streams[part]), strict=True):
                payload = (samples + 128).astype(np.uint8).tobytes()
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(sha256(payload))
                out["tail_crc32"].append(zlib.crc32(payload[-64:]))
                out["media_bytes"].append(len(stream))
                out["media_sha256"].append(sha256(stream))
                out["feature"].append(features(samples))
                out["n_blocks"].append(len(blocks))
        return out

    return map_rows(media.select("doc_id", "n_bytes", "media"), run, schema)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """One row per block: doc_id, block, first_sample, n_samples, frame_offset (bytes in the stream) and pcm (signed bytes)."""
    block = T.StructType(
        [T.StructField("first_sample", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("frame_offset", T.LongType()), T.StructField("pcm", T.BinaryType())]
    )
    schema = T.StructType([media.schema["doc_id"], T.StructField("blocks", T.ArrayType(block))])

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = []
        for part in _groups(cols["media"]):
            for samples, blocks in decode_many(cols["media"][part]):
                pcm = samples.astype(np.int8)
                rows.append([{"first_sample": a, "n_samples": n, "frame_offset": o, "pcm": pcm[a : a + n].tobytes()} for a, n, o in blocks])
        return {"doc_id": cols["doc_id"], "blocks": rows}

    from pyspark.sql import functions as F

    return map_rows(media.select("doc_id", "media"), run, schema).select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", "block", "b.*")


def query(spark, sf_dir: str) -> DataFrame:
    return read_media(write_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
