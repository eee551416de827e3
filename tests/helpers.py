"""Small numpy oracles and frame makers."""

import struct
import zlib

import numpy as np


def frames_df(spark, arrays, first=0):
    """Frames table from gray, BGR or BGRA uint8 arrays."""
    rows = []
    for k, a in enumerate(arrays, first):
        c = 1 if a.ndim == 2 else a.shape[2]
        rows.append((k, a.shape[0], a.shape[1], c, bytearray(np.ascontiguousarray(a).tobytes())))
    return spark.createDataFrame(rows, "frame_id long, height int, width int, n_channels int, data binary")


def plane(lines, col="vals"):
    out = {}
    for r in lines.collect():
        out.setdefault(r.frame_id, {})[r.y] = r[col]
    return {k: np.array([v[y] for y in sorted(v)]) for k, v in out.items()}


def luma(a):
    a = a.astype(np.int64)
    return (((a[..., 0] * 3735 + a[..., 1] * 19235 + a[..., 2] * 9798) + (1 << 14)) >> 15).astype(float)


def sobel(g):
    p = np.pad(g, 1, mode="reflect")
    h, w = g.shape
    s = lambda dy, dx: p[1 + dy:1 + dy + h, 1 + dx:1 + dx + w]
    gx = s(-1, 1) - s(-1, -1) + 2 * (s(0, 1) - s(0, -1)) + s(1, 1) - s(1, -1)
    gy = s(1, -1) - s(-1, -1) + 2 * (s(1, 0) - s(-1, 0)) + s(1, 1) - s(-1, 1)
    return np.hypot(gx, gy)


def laplacian(g):
    p = np.pad(g, 1, mode="reflect")
    h, w = g.shape
    s = lambda dy, dx: p[1 + dy:1 + dy + h, 1 + dx:1 + dx + w]
    return 2 * (s(-1, -1) + s(-1, 1) + s(1, -1) + s(1, 1)) - 8 * g


def blur(g, taps, u8=True):
    t = np.array(taps)
    r = len(t) // 2
    h, w = g.shape
    q = np.pad(g, r, mode="reflect")
    b = sum(t[j] * q[:, j:j + w] for j in range(len(t)))
    b = sum(t[j] * b[j:j + h] for j in range(len(t)))
    return np.floor(b + 0.5) if u8 else b


def components(mask, diagonal=True):
    """Label map by flood fill; 0 is clear."""
    lab = np.zeros(mask.shape, int)
    n = 0
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not (dy and dx))]
    for y, x in zip(*np.nonzero(mask)):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        lab[y, x] = n
        while todo:
            cy, cx = todo.pop()
            for dy, dx in near:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not lab[ny, nx]:
                    lab[ny, nx] = n
                    todo.append((ny, nx))
    return lab


def disc(n, cy, cx, r, on=200, off=20):
    y, x = np.indices((n, n))
    return np.where((y - cy) ** 2 + (x - cx) ** 2 <= r * r, on, off).astype(np.uint8)


def png(path, bgr):
    """Write an 8-bit RGB PNG."""
    h, w = bgr.shape[:2]
    raw = b"".join(b"\0" + bgr[y, :, ::-1].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
