"""FLAC media columns: a lossless encoder and a decoder, vectorised over frames.

Payloads are stored as 8-bit mono streams: STREAMINFO with the MD5 of the samples, an
APPLICATION block with the size of every frame, a SEEKTABLE, and frames of BLOCK samples,
each a constant, verbatim, fixed-predictor or linear-predictor subframe with Rice-coded
residuals, closed by CRC-8 and CRC-16.  The decoder reads any mono or stereo stream of 4
to 24 bits with Rice or Rice2 partitions; frames of a stream with sizes lie where these
say, those of another stream are walked from header to header, where the CRC-16 of the
frame before decides between headers of one number (samples may look like headers).  It
verifies both checksums of every frame and the MD5, and decodes all frames of a batch
side by side: step i decodes the i-th residual of every frame.  A checksum that does not
hold raises ValueError.

Null and empty payloads are stored as one block of 64 zero bytes by the query; the
encoder itself takes any length from 1 sample on.  Equal payloads give equal streams.
"""
from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 256
RATE = 8000
LPC_ORDER = 4
LPC_BITS = 12
#: Frames between two seek points.
SEEK = 64
#: Name of the APPLICATION block that holds the sizes of the frames, two bytes each.
SIZES = b"fsiz"
#: Samples encoded, and frames decoded, at once.
CHUNK = 1 << 19
FRAMES = 8192
#: Unsigned bytes to signed samples, as bytes.
_SIGN = bytes(range(128, 256)) + bytes(range(128))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Checksums of data[start:start + size] for many ranges at once."""
    wide = table is CRC16
    crc = np.zeros(len(start), np.int64)
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    c = crc[order]
    for i in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -i, "left"))
        b = data[s[:m] + i]
        c[:m] = table[c[:m] >> 8 ^ b] ^ (c[:m] << 8 & 0xFFFF) if wide else table[c[:m] ^ b]
    crc[order] = c
    return crc


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 coding: bytes (n x 4) and how many."""
    if len(n) and n.max() >= 1 << 21:
        raise ValueError("too many frames")
    size = 1 + (n > 0x7F) + (n > 0x7FF) + (n > 0xFFFF)
    out = np.zeros((len(n), 4), np.uint8)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for i in range(4):
        shift = 6 * (size - 1 - i)
        v = n >> np.maximum(shift, 0) & 0x3F | 0x80
        v = np.where(i == 0, np.where(size == 1, n, lead[size] | n >> np.maximum(shift, 0)), v)
        out[:, i] = np.where(i < size, v, 0)
    return out, size


def _predict(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Linear prediction of each sample from those before it (rows are frames)."""
    p = np.zeros_like(x)
    for j in range(coef.shape[1]):
        p[:, j + 1:] += coef[:, j:j + 1] * x[:, :x.shape[1] - j - 1]
    return p >> shift[:, None]


def _lpc(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of each frame, by the autocorrelation method."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, k:] * f[:, :f.shape[1] - k]).sum(axis=1) for k in range(LPC_ORDER + 1)], axis=1)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-3
    lag = np.abs(np.subtract.outer(np.arange(LPC_ORDER), np.arange(LPC_ORDER)))
    a = np.linalg.solve(r[:, lag], r[:, 1:, None])[:, :, 0]
    top = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(top)).astype(np.int64), 0, 15)
    most = (1 << (LPC_BITS - 1)) - 1
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int64)
    return q, shift


def _frames(parts: list[bytes], begin: list[int]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """For each part (a run of samples whose first frame has the number begin): its
    frames' bytes, and their sizes and lengths."""
    sizes = np.array([len(p) for p in parts], np.int64)
    frames = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(parts)), frames)
    local = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    number = local + np.array(begin, np.int64)[owner]
    length = np.minimum(BLOCK, sizes[owner] - local * BLOCK)
    x = np.zeros((len(owner), BLOCK), np.int64)
    inside = np.arange(BLOCK) < length[:, None]
    x[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) - 128
    # candidates: fixed orders 0 to 2 and a linear predictor
    coef, shift = _lpc(x, length)
    res = [x, np.diff(x, axis=1, prepend=0), np.diff(x, n=2, axis=1, prepend=[[0, 0]] * len(x)) if len(x) else x, x - _predict(x, coef, shift)]
    orders = np.array([0, 1, 2, LPC_ORDER])
    extra = np.array([0, 0, 0, 9 + LPC_BITS * LPC_ORDER])
    cost, rice = [], []
    for r, o, e in zip(res, orders, extra):
        u = np.where(inside & (np.arange(BLOCK) >= o), r << 1 ^ r >> 63, 0)
        n = np.maximum(length - o, 1)
        k = np.clip(np.floor(np.log2(np.maximum(u.sum(axis=1) / n * 0.7, 1))).astype(np.int64), 0, 14)
        cost.append(np.where(length > o, 8 + 8 * o + e + 10 + (k + 1) * (length - o) + (u >> k[:, None]).sum(axis=1), 1 << 40))
        rice.append(k)
    cost.append(8 + 8 * length)
    cost.append(np.where((x == x[:, :1]).sum(axis=1) >= BLOCK, 16, np.where(((x == x[:, :1]) | ~inside).all(axis=1), 16, 1 << 40)))
    kind = np.argmin(np.stack(cost), axis=0)
    body_bits = np.stack(cost)[kind, np.arange(len(kind))]
    num, num_size = _number(number)
    short = length != BLOCK
    head = 4 + num_size + short + 1
    size = head + (body_bits + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(start[-1]), np.uint8)
    at = start[:-1]
    out[at], out[at + 1] = 0xFF, 0xF8
    out[at + 2] = np.where(short, 6, 8) << 4
    out[at + 3] = 1 << 1
    for i in range(4):
        m = num_size > i
        out[at[m] + 4 + i] = num[m, i]
    out[(at + 4 + num_size)[short]] = length[short] - 1
    out[at + head - 1] = crcs(out, at, head - 1, CRC8)
    bits = np.zeros(len(out) * 8, np.uint8)

    def put(where: np.ndarray, value: np.ndarray, width: int):
        for j in range(width):
            bits[where + j] = value >> (width - 1 - j) & 1

    body = (at + head) * 8
    put(body, np.choose(kind, [8 << 1, 9 << 1, 10 << 1, (32 + LPC_ORDER - 1) << 1, 1 << 1, 0]), 8)
    for k in range(4):
        f = np.flatnonzero(kind == k)
        if not len(f):
            continue
        o, pos = int(orders[k]), body[f] + 8
        for i in range(o):
            put(pos, x[f, i] & 0xFF, 8)
            pos = pos + 8
        if k == 3:
            put(pos, np.full(len(f), LPC_BITS - 1), 4)
            put(pos + 4, shift[f], 5)
            for i in range(o):
                put(pos + 9 + LPC_BITS * i, coef[f, i] & ((1 << LPC_BITS) - 1), LPC_BITS)
            pos = pos + 9 + LPC_BITS * o
        kk = rice[k][f]
        put(pos + 6, kk, 4)
        u = res[k][f] << 1 ^ res[k][f] >> 63
        q = u >> kk[:, None]
        real = inside[f] & (np.arange(BLOCK) >= o)
        step = np.where(real, q + 1 + kk[:, None], 0)
        one = pos[:, None] + 10 + np.cumsum(step, axis=1) - step + q
        bits[one[real]] = 1
        for j in range(int(kk.max())):
            m = real & (kk[:, None] > j)
            low = np.maximum(kk[:, None] - 1 - j, 0)
            bits[(one + 1 + j)[m]] = (u >> low & 1)[m]
    f = np.flatnonzero(kind == 4)
    if len(f):
        w = (body[f] + 8)[:, None] + 8 * np.arange(BLOCK)
        for j in range(8):
            bits[(w + j)[inside[f]]] = (x[f] >> (7 - j) & 1)[inside[f]]
    f = np.flatnonzero(kind == 5)
    put(body[f] + 8, x[f, 0] & 0xFF, 8)
    out |= np.packbits(bits)
    crc = crcs(out, at, size - 2, CRC16)
    out[at + size - 2], out[at + size - 1] = crc >> 8, crc & 255
    data, edge = out.tobytes(), np.concatenate([[0], np.cumsum(frames)])
    return [(data[start[a]:start[b]], size[a:b], length[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of unsigned bytes (stored as signed samples)."""
    if any(not p for p in payloads):
        raise ValueError("an empty payload has no samples")
    made: list[list] = [[] for _ in payloads]
    group: list[tuple[int, bytes, int]] = []

    def flush():
        for (i, _, _), got in zip(group, _frames([p for _, p, _ in group], [n for _, _, n in group])):
            made[i].append(got)
        group.clear()

    held = 0
    for i, p in enumerate(payloads):
        for at in range(0, len(p), CHUNK):
            part = p[at:at + CHUNK]
            if group and held + len(part) > CHUNK:
                flush()
                held = 0
            group.append((i, part, at // BLOCK))
            held += len(part)
    if group:
        flush()
    streams = []
    for p, got in zip(payloads, made):
        size, length = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
        md5 = hashlib.md5(bytes(p).translate(_SIGN)).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        start = np.cumsum(size) - size
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(start[i]), int(length[i])) for i in range(0, len(size), SEEK))
        sizes = SIZES + size.astype(">u2").tobytes()
        streams.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x02" + len(sizes).to_bytes(3, "big") + sizes + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(g[0] for g in got))
    return streams


def _metadata(stream: bytes) -> tuple[dict, int]:
    """STREAMINFO fields, and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, last, sizes = 4, None, False, None
    while not last:
        if at + 4 > len(stream):
            raise ValueError("the stream ends within its metadata")
        last, kind, n = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1:at + 4], "big")
        if kind == 0:
            b = stream[at + 4:at + 4 + n]
            v = int.from_bytes(b[10:18], "big")
            info = {"block": int.from_bytes(b[2:4], "big"), "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": b[18:34]}
        elif kind == 2 and stream[at + 4:at + 8] == SIZES and n % 2 == 0:
            sizes = np.frombuffer(stream[at + 8:at + 4 + n], ">u2").astype(np.int64)
        at += 4 + n
    if info is None:
        raise ValueError("no STREAMINFO")
    if sizes is not None and (int(sizes.sum()) != len(stream) - at or (sizes < 8).any()):
        raise ValueError("the frames' sizes do not fit the stream")
    return info | {"sizes": sizes}, at


class _Bits:
    """Bit pointers into one buffer, one per frame, moved together."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.lib.stride_tricks.as_strided(padded, (len(data) + 8, 8), (1, 1)).copy().view(">u8").astype(np.uint64).ravel()
        self.at = at * 8

    def peek(self, who: np.ndarray) -> np.ndarray:
        """The next 32 bits."""
        at = self.at[who]
        return (self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64) >> np.uint64(32)).astype(np.int64)

    def take(self, who: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """width bits (32 at most) of each, as unsigned."""
        v = self.peek(who) >> (32 - width)
        self.at[who] += width
        return np.where(np.asarray(width) > 0, v, 0)

    def signed(self, who: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v = self.take(who, width)
        w = np.asarray(width)
        return np.where(w > 0, v - ((v >> np.maximum(w - 1, 0) & 1) << w), 0)

    def unary(self, who: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is passed too."""
        v = self.peek(who)
        n = 32 - np.frexp(v.astype(np.float64))[1].astype(np.int64)
        n[v == 0] = 32
        self.at[who] += n + 1
        more = np.flatnonzero(v == 0)
        if len(more):
            self.at[who[more]] -= 1
            if self.at[who[more]].max() >= len(self.words) * 8:
                raise ValueError("a frame ends within a code")
            n[more] += self.unary(who[more])
        return n


def _residuals(bits: _Bits, who: np.ndarray, order: np.ndarray, block: np.ndarray, out: np.ndarray):
    """Rice or Rice2 partitions of the frames who, into out[who, order:block]."""
    wide = 4 + bits.take(who, 2)
    parts = bits.take(who, 4)
    psize = block[who] >> parts
    k, raw = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
    least = int(psize.min()) if len(who) else 1
    for i in range(int(block[who].max()) if len(who) else 0):
        go = (i >= order) & (i < block[who])
        if i == 0 or i % max(least, 1) == 0 or i <= 32:
            new = np.flatnonzero(go & ((i % psize == 0) | (i == order)))
            if len(new):
                k[new] = bits.take(who[new], wide[new])
                escaped = new[k[new] == (1 << wide[new]) - 1]
                raw[new] = -1
                if len(escaped):
                    raw[escaped] = bits.take(who[escaped], 5)
        rice = np.flatnonzero(go & (raw < 0))
        lanes = who[rice]
        q = bits.unary(lanes)
        u = q << k[rice] | bits.take(lanes, k[rice])
        out[lanes, i] = u >> 1 ^ -(u & 1)
        plain = np.flatnonzero(go & (raw >= 0))
        if len(plain):
            out[who[plain], i] = bits.signed(who[plain], raw[plain])


def _subframes(bits: _Bits, who: np.ndarray, block: np.ndarray, depth: np.ndarray, width: int) -> np.ndarray:
    """Samples of one channel of every frame."""
    out = np.zeros((len(block), width), np.int64)
    head = bits.take(who, 8)
    kind = head >> 1 & 0x3F
    wasted = np.zeros(len(who), np.int64)
    w = np.flatnonzero(head & 1)
    if len(w):
        wasted[w] = bits.unary(who[w]) + 1
    deep = depth - wasted
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any() or (head >> 7).any():
        raise ValueError("reserved subframe")
    for i in np.unique(kind):
        lanes = who[kind == i]
        d = deep[kind == i]
        if i == 0:
            out[lanes] = bits.signed(lanes, d)[:, None]
        elif i == 1:
            for j in range(int(block[lanes].max())):
                on = j < block[lanes]
                out[lanes[on], j] = bits.signed(lanes[on], d[on])
    pred = np.flatnonzero(kind >= 8)
    if len(pred):
        lanes, d = who[pred], deep[pred]
        lpc = kind[pred] >= 32
        order = np.where(lpc, kind[pred] - 31, kind[pred] - 8)
        for j in range(int(order.max())):
            on = j < order
            out[lanes[on], j] = bits.signed(lanes[on], d[on])
        # fixed predictors of order 0 to 4 are linear ones with binomial coefficients
        fixed = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]])
        coef = np.zeros((len(pred), max(4, int(order.max()))), np.int64)
        coef[~lpc, :4] = fixed[order[~lpc]]
        shift = np.zeros(len(pred), np.int64)
        m = np.flatnonzero(lpc)
        if len(m):
            prec = bits.take(lanes[m], 4) + 1
            shift[m] = bits.signed(lanes[m], 5)
            if (shift < 0).any() or (prec == 16).any():
                raise ValueError("invalid predictor")
            for j in range(int(order[m].max())):
                on = j < order[m]
                coef[m[on], j] = bits.signed(lanes[m][on], prec[on])
        res = np.zeros_like(out)
        _residuals(bits, lanes, order, block, res)
        for o in np.unique(order):
            g = np.flatnonzero(order == o)
            x, r = out[lanes[g]], res[lanes[g]]
            c, s = coef[g, :o], shift[g]
            if o == 0:
                x = r
            else:
                for i in range(int(o), width):
                    x[:, i] = r[:, i] + ((c * x[:, i - o:i][:, ::-1]).sum(axis=1) >> s)
            out[lanes[g]] = x
    out[who] <<= wasted[:, None]
    return out


def _headers(data: np.ndarray, begin: np.ndarray, end: np.ndarray, infos: list[dict]):
    """Start, header size, block size, number and stream of every frame."""
    cand = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] & 0xFE == 0xF8)) if len(data) > 1 else np.zeros(0, np.int64)
    sized = np.array([i["sizes"] is not None for i in infos])
    if sized.any():
        told = [b + np.cumsum(i["sizes"]) - i["sizes"] for b, i in zip(begin.tolist(), infos) if i["sizes"] is not None]
        owner = np.searchsorted(begin, cand, "right") - 1
        cand = np.union1d(cand[(owner < 0) | ~sized[np.maximum(owner, 0)]], np.concatenate(told)).astype(np.int64)
    owner = np.searchsorted(begin, cand, "right") - 1
    ok = (owner >= 0) & (cand + 6 <= end[np.maximum(owner, 0)])
    cand, owner = cand[ok], owner[ok]
    pad = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.int64)
    code, lead = pad[cand + 2] >> 4, pad[cand + 4]
    size = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8], [1, 9, 2, 3, 4], 9)
    ok = (size < 9) & (code > 0)
    cand, owner, code, size, lead = (v[ok] for v in (cand, owner, code, size, lead))
    number = np.select([size == 1, size == 2, size == 3], [lead, lead & 0x1F, lead & 0xF], lead & 7)
    for i in range(1, 4):
        number = np.where(i < size, number << 6 | pad[cand + 4 + i] & 0x3F, number)
    after = cand + 4 + size
    rate = pad[cand + 2] & 15
    block = np.select([code == 1, code <= 5, code == 6, code == 7], [192, 576 << np.maximum(code - 2, 0), pad[after] + 1, (pad[after] << 8 | pad[after + 1]) + 1], 256 << np.maximum(code - 8, 0))
    head = 4 + size + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0) + 1
    ok = (cand + head <= end[owner]) & (crcs(pad, cand, head - 1, CRC8) == pad[cand + head - 1])
    cand, owner, number, block, head = (v[ok] for v in (cand, owner, number, block, head))
    # numbers count frames, or samples where blocks vary
    step = np.where(data[cand + 1] & 1, block, 1)
    keep = [np.flatnonzero(sized[owner])]
    edge = np.searchsorted(owner, np.arange(len(infos) + 1))
    for o in np.flatnonzero(~sized).tolist():
        a, b = int(edge[o]), int(edge[o + 1])
        keep.append(a + _walk(pad, cand[a:b], number[a:b], step[a:b], int(begin[o]), int(end[o])))
    keep = np.sort(np.concatenate(keep))
    return cand[keep], head[keep], block[keep], owner[keep]


def _walk(pad: np.ndarray, cand: np.ndarray, number: np.ndarray, step: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Which of a stream's possible headers are its frames: a path from the first byte to
    the end on which numbers follow each other and every frame's CRC-16 holds.  Paths are
    tried depth first; one possible follower, the usual case, needs no checksum here."""
    follow: dict[int, list[int]] = {}
    for i, n in enumerate(number.tolist()):
        follow.setdefault(n, []).append(i)

    def whole(i: int, stop: int) -> bool:
        start = int(cand[i])
        return stop - start > 2 and int(crcs(pad, np.array([start]), np.array([stop - start - 2]), CRC16)[0]) == int(pad[stop - 2] << 8 | pad[stop - 1])

    def after(i: int):
        later = [j for j in follow.get(int(number[i] + step[i]), ()) if cand[j] > cand[i]]
        return iter(later if len(later) < 2 else [j for j in later if whole(i, int(cand[j]))])

    if not len(cand) or cand[0] != begin or number[0] != 0:
        return np.zeros(0, np.int64)
    path, ways = [0], [after(0)]
    while path:
        j = next(ways[-1], None)
        if j is not None:
            path.append(j)
            ways.append(after(j))
        elif whole(path[-1], end):
            return np.array(path, np.int64)
        else:
            path.pop()
            ways.pop()
    return np.zeros(0, np.int64)


def _samples(data, at, head, stop, block, mode, depth, channels) -> list[np.ndarray]:
    """Samples (block x channels) of each frame."""
    base = int(at[0])
    bits = _Bits(data[base:int(stop[-1])], at - base + head)
    width = int(block.max())
    side = mode == 9, (mode == 8) | (mode == 10)
    x = []
    for c in range(int(channels.max())):
        who = np.flatnonzero(channels > c)
        x.append(_subframes(bits, who, block, depth[who] + side[c][who], width))
    if len(x) == 2:
        a, b = x
        left, right, mid = mode == 8, mode == 9, mode == 10
        b[left] = a[left] - b[left]
        a[right] += b[right]
        m, s = a[mid] << 1 | b[mid] & 1, b[mid]
        a[mid], b[mid] = (m + s) >> 1, (m - s) >> 1
    if ((bits.at + 7) // 8 + base != stop - 2).any():
        raise ValueError("a frame has other data than its codes")
    return [np.stack([v[i, :n] for v in x[:c]], axis=1) for i, (n, c) in enumerate(zip(block.tolist(), channels.tolist()))]


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each stream its samples (n x channels) and the sample and byte offsets and
    sizes of its frames (m x 3).  Checksums that fail raise ValueError."""
    infos, starts = zip(*(_metadata(s) for s in streams)) if streams else ((), ())
    base = np.cumsum([0] + [len(s) for s in streams])
    data = np.frombuffer(b"".join(streams), np.uint8)
    begin = base[:-1] + np.array(starts, np.int64)
    at, head, block, owner = _headers(data, begin, base[1:], list(infos))
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    stop = np.where(np.append(first[1:], True), base[1:][owner], np.append(at[1:], 0)) if len(owner) else at
    crc = crcs(data, at, stop - at - 2, CRC16)
    if (crc != (data[stop - 2].astype(np.int64) << 8 | data[stop - 1])).any() or (at[first] != begin[owner[first]]).any():
        raise ValueError("a frame's checksum does not hold")
    if len(set(owner.tolist())) != sum(i["samples"] > 0 for i in infos):
        raise ValueError("a stream has no frame")
    mode = data[at + 3].astype(np.int64) >> 4
    code = data[at + 3].astype(np.int64) >> 1 & 7
    given = np.array([i["bits"] for i in infos])[owner] if len(owner) else at
    depth = np.array([0, 8, 12, 0, 16, 20, 24, 32])[code]
    depth = np.where(code == 0, given, depth)
    channels = np.where(mode < 8, mode + 1, 2)
    if len(channels) and channels.max() > 2:
        raise ValueError("more than two channels")
    parts = [_samples(data, *(v[i:i + FRAMES] for v in (at, head, stop, block, mode, depth, channels))) for i in range(0, len(at), FRAMES)]
    x = [s for p in parts for s in p]
    out, edge = [], np.searchsorted(owner, np.arange(len(streams) + 1))
    for i, info in enumerate(infos):
        a, b = edge[i], edge[i + 1]
        s = np.concatenate(x[a:b]) if b > a else np.zeros((0, info["channels"]), np.int64)
        step = (info["bits"] + 7) // 8
        raw = np.ascontiguousarray(s.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :step].tobytes()
        if any(info["md5"]) and hashlib.md5(raw).digest() != info["md5"] or info["samples"] not in (0, len(s)):
            raise ValueError("the samples' checksum does not hold")
        begins = np.cumsum(block[a:b]) - block[a:b]
        out.append((s, np.stack([begins, at[a:b] - base[i], block[a:b]], axis=1)))
    return out
