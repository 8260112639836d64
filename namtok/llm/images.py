"""Decoding and describing images: multiscale corners with orientation-normalised binary tests."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np

#: Scales of the pyramid, corners kept of a tile of an image (the strongest), radius of the described patch, and number of binary tests.
SCALES, FEATURES, RADIUS, TESTS = (1.0, 0.8, 0.64, 0.512), 64, 16, 256
#: Side of a tile in pixels; an image has as many corners as its area asks for, spread over all of it.
TILE = 128
#: Test places: x and y of both points of each test, a letter of base 64 each, 16 for 0. Of random tests these are the evenest on
#: corners of drawn and of smooth random pictures of which no two agree too often; tests drawn blindly agree for corners of any two pictures.
PLACES = (
    "LTKQJYOVTKWHNDUAQFYRLLOMJHNGgLZXQVOHQaQCIUMULRDYcTSOLGIeNgacQPQWOGTgPgEGFHEPeQcNLMLYICPKPfJfARWeAUYDMCKGLGNXRaTQQVgLaDTcNUMZJEgO"
    "IJDGYbVAWYgQYaXfIZMDQebWWQZROMNUOHRFdUZZPWQcLYPGUASILDMAYBHHIaMgaXbQTcSJOJODSCVAQXVgOAUIRRWXPJeNRZVaSSNXgRTDZOXUOUQXVHVKNCXbKXWa"
    "aRdWTbcbPaLDKZSKLTPBNHQJNZIZLAOAcLbRSNAOTeIRUVVNULPfIQLEVgMMBUQKTZPWHVJSXZZHUMbNBKQAKNKRRWNANfLARbSYEZEcKWNSQLNKPXYFKIKFQEQSgPVQ"
    "YKgMRVVQHJTdRPUgPPfXDaOGQJQZGbMbSOUKBMLcXDdHQIEKERIJRDTXeXWOICXHNNQLKdPbSERNNZQaQbTGIVGSgTgQPYQUSMXNOJYbVLZXIDEISHZIKYWCEcGMcXHe"
    "HRGNWXVSRYANQTYJHaEFOWSGXPUPTBQAIGJMacSMUfgTASMRANFSOHHTGRHZKBCUOGSaILMLKSCJLGHFKQPNNJONZWWbBJUgBYGTLfPMVSaDKFTONWMTPeYGEOPQULQN"
    "FWAQPMRJFVSaTUZWUENdcOaKUMSHEGQOKaQPSfTBHYOKRaNgQFWFSSXbKRNQVKZCWZaXUTcMYBcPYIVOQTGKYTXPRMQPQWTWTSQPKcUWSRVRJRFQPJTLNPNMdIaNQVAV"
    "ZIWJMfNZSAEYLgfPTRXOYaTZJfQASFYeaVcZSYNMOcLIUPQLINPZXNUdLNLKHLHWJLNQREEQEUNOPVeUSadJHMATDQKWEEQVIeUOPRJBTAPVOGOLKeGbWdWWRgbLANGF"
    "CTNaLAgUcbVUBKMINAQDPOXESTVGYPWHTNUQFMKOMOORDYGaLUOWIcVgdKRQQgBWSAZLPIfXWIfUOSJUNZGIUEYWLXIdVJRJLgRSfLXGcEYHJdITSgTaUGHcTAJOPgNR"
)
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PATTERN = np.array([_LETTERS.index(c) - 16.0 for c in PLACES]).reshape(TESTS, 2, 2)
#: Votes count places that are further apart than this many pixels: a corner found at several scales is one.
APART = 3.0


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM, or of a PNG of 8 bits a channel without interlacing; None for all else."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
                    at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
                end = at
                while data[end : end + 1].isdigit():
                    end += 1
                fields.append(int(data[at:end]))
                at = end
            width, height, top = fields
            channels = 1 if data[:2] == b"P5" else 3
            if top > 255:
                return None
            pixels = np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            pixels = _png(data)
            if pixels is None:
                return None
        else:
            return None
        return pixels[:, :, :3].mean(axis=2) if pixels.shape[2] >= 3 else pixels[:, :, 0].astype(float)
    except (ValueError, TypeError, IndexError, struct.error, zlib.error):
        return None


def _png(data: bytes) -> np.ndarray | None:
    at, body, head = 8, b"", None
    while at < len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + length
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        return None
    size = height * (1 + width * channels)
    raw = np.frombuffer(zlib.decompressobj().decompress(body, size), np.uint8).reshape(height, 1 + width * channels)  # no more than the header says
    out = np.zeros((height, width, channels), np.uint8)
    for y in range(height):
        line, above = raw[y, 1:].reshape(width, channels).astype(int), out[y - 1].astype(int) if y else np.zeros((width, channels), int)
        kind = raw[y, 0]
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line, axis=0)
        elif kind in (3, 4):
            left, corner = np.zeros(channels, int), np.zeros(channels, int)
            for x in range(width):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left = line[x] = (line[x] + guess) & 255
                corner = up
        out[y] = line & 255
    return out


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def _box(image: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2 r + 1, with the edge repeated."""
    k = 2 * r + 1
    padded = np.pad(image, ((r + 1, r), (r + 1, r)), "edge")
    padded[0], padded[:, 0] = 0, 0
    sums = padded.cumsum(axis=0).cumsum(axis=1)
    return sums[k:, k:] - sums[:-k, k:] - sums[k:, :-k] + sums[:-k, :-k]


def _resize(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, from a slightly blurred image."""
    if scale == 1:
        return image
    blurred = _box(image, 1) / 9
    h, w = int(image.shape[0] * scale), int(image.shape[1] * scale)
    y, x = np.minimum(np.arange(h) / scale, image.shape[0] - 1.001), np.minimum(np.arange(w) / scale, image.shape[1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    u, v = (y - i)[:, None], (x - j)[None, :]
    a, b = blurred[i], blurred[i + 1]
    return (a[:, j] * (1 - v) + a[:, j + 1] * v) * (1 - u) + (b[:, j] * (1 - v) + b[:, j + 1] * v) * u


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, descriptors): x, y, angle and scale of the strongest corners of each tile, and TESTS bits each as bytes.

    Corners are local maxima of the Harris response at each scale. A corner's angle points from it to
    its patch's centre of brightness less the patch's mean, and its test places are turned by it.
    """
    none = np.zeros((0, 4)), np.zeros((0, TESTS // 8), np.uint8)
    border = RADIUS + 5
    found = []
    if image is None:
        return none
    levels = []
    for scale in SCALES:
        level = _resize(image, scale)
        levels.append(_box(level, 2) / 25 if min(level.shape) > 5 else level)
        if min(level.shape) <= 2 * border + 2:
            continue
        gx, gy = np.gradient(level, axis=1), np.gradient(level, axis=0)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[border:-border, border:-border]
        around = response[border - 2 : response.shape[0] - border + 2, border - 2 : response.shape[1] - border + 2]
        rows = np.maximum.reduce([around[k : k + inner.shape[0]] for k in range(5)])
        peak = inner >= np.maximum.reduce([rows[:, k : k + inner.shape[1]] for k in range(5)])
        y, x = np.nonzero(peak & (inner > 1.0))
        found += [(float(inner[b, a]), len(levels) - 1, int(a) + border, int(b) + border) for b, a in zip(y, x, strict=True)]
    if not found:
        return none
    strongest, kept = sorted(found, key=lambda f: (-f[0], *f[1:])), Counter()
    found = []
    for f in strongest:
        tile = f[2] / SCALES[f[1]] // TILE, f[3] / SCALES[f[1]] // TILE
        kept[tile] += 1
        if kept[tile] <= FEATURES:
            found.append(f)
    grid = np.arange(-RADIUS, RADIUS + 1)
    disc = grid[:, None] ** 2 + grid[None, :] ** 2 <= RADIUS**2
    places, bits = np.zeros((len(found), 4)), np.zeros((len(found), TESTS), bool)
    for level, smooth in enumerate(levels):
        own = [k for k, f in enumerate(found) if f[1] == level]
        if not own:
            continue
        x, y = np.array([found[k][2:] for k in own]).T
        patch = smooth[(y[:, None] + grid)[:, :, None], (x[:, None] + grid)[:, None, :]] * disc
        weight = (patch - (patch.sum(axis=(1, 2)) / disc.sum())[:, None, None]) * disc
        angle = np.arctan2((weight * grid[:, None]).sum(axis=(1, 2)), (weight * grid).sum(axis=(1, 2)))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.clip(np.rint(x[:, None, None] + PATTERN[..., 0] * c - PATTERN[..., 1] * s).astype(int), 0, smooth.shape[1] - 1)
        py = np.clip(np.rint(y[:, None, None] + PATTERN[..., 0] * s + PATTERN[..., 1] * c).astype(int), 0, smooth.shape[0] - 1)
        value = smooth[py, px]
        places[own] = np.stack([x / SCALES[level], y / SCALES[level], angle, np.full(len(own), SCALES[level])], axis=1)
        bits[own] = value[..., 0] < value[..., 1]
    return places, np.packbits(bits, axis=1)


def spread(places: np.ndarray, enough: int) -> int:
    """Places x, y of which no two lie within APART, picked in order, up to so many."""
    kept: list[tuple[float, float]] = []
    for x, y in places.tolist():
        if all((x - u) ** 2 + (y - v) ** 2 > APART * APART for u, v in kept):
            kept.append((x, y))
            if len(kept) == enough:
                break
    return len(kept)


def inliers(matches: np.ndarray, tolerance: float = 4.0, enough: int = 1 << 30) -> int:
    """Most matches (x, y, angle, scale of one image, the same of the other) that one similarity explains, or ``enough``.

    Each match proposes the turn, scale and shift that carry its corner over; corners of either
    image that lie within APART count once.
    """
    a, b, best = matches[:, :4], matches[:, 4:], 0
    for at in range(0, len(matches), 256):  # bounds memory for images of many corners
        one, two = a[at : at + 256], b[at : at + 256]
        turn, ratio = two[:, 2] - one[:, 2], one[:, 3] / two[:, 3]
        c, s = (ratio * np.cos(turn))[:, None], (ratio * np.sin(turn))[:, None]
        dx, dy = a[None, :, 0] - one[:, None, 0], a[None, :, 1] - one[:, None, 1]
        off = np.hypot(two[:, None, 0] + c * dx - s * dy - b[None, :, 0], two[:, None, 1] + s * dx + c * dy - b[None, :, 1])
        bend = (b[:, 2] - a[:, 2])[None, :] - turn[:, None]
        good = (off <= tolerance) & (np.abs((bend + np.pi) % (2 * np.pi) - np.pi) < 0.35)
        count = good.sum(axis=1)
        for i in np.argsort(-count):
            if count[i] <= best:
                break
            best = max(best, min(spread(a[good[i], :2], enough), spread(b[good[i], :2], enough)))
            if best >= enough:
                return best
    return best
