"""DuckDB SQL for the pieces that the catalog's queries share, as common table expressions."""

from __future__ import annotations

import math

from lodestone.functions import hashing
from lodestone.sources.params import block_key  # noqa: F401  the SQL below states the same key

EMB = "emb AS (SELECT vec_id AS id, t.f AS f, CAST(embedding[t.f + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS t(f))"
LABELS = "tgt AS (SELECT vec_id AS record_id, CAST(label AS BIGINT) AS label FROM embeddings)"
SPARSE = "sp AS (SELECT l_orderkey AS id, l_partkey % 500 AS f, CAST(sum(l_quantity) AS DOUBLE) / 50 AS v FROM lineitem GROUP BY ALL)"
SPARSE_LABELS = "st AS (SELECT DISTINCT l_orderkey AS record_id, l_suppkey % 50 AS label FROM lineitem)"


def order(f: str, perm: str) -> str:
    return f"(({f}::BIGINT * 2654435761 + {perm}::BIGINT * 40503 + {hashing.SEED}) % 2147483647)"


def layer(name: str, number: int, nodes: int, dim: int) -> str:
    return (
        f"{name}w AS (SELECT n.n AS node, d.f AS f, CAST((n.n * 7919 + d.f * 104729 + {number * 1299709}) % 2003 - 1001 AS DOUBLE) / 10010.0::DOUBLE AS w FROM range({nodes}) AS n(n), range({dim}) AS d(f)), "
        f"{name}b AS (SELECT n.n AS node, CAST((n.n * 31 + {number * 17}) % 101 - 50 AS DOUBLE) / 1000.0::DOUBLE AS b FROM range({nodes}) AS n(n))"
    )


def layer_of(name: str, number: int, dim: int) -> str:
    """The weights of a layer with a node for each embedding."""
    return f"{name}w AS (SELECT vec_id AS node, d.f AS f, CAST((vec_id * 7919 + d.f * 104729 + {number * 1299709}) % 2003 - 1001 AS DOUBLE) / 10010.0::DOUBLE AS w FROM embeddings, range({dim}) AS d(f))"


def layout(dim: int, hashes: int) -> str:
    perms = hashing.permutations(dim, hashes)
    return (
        f"lay0 AS (SELECT p.p AS perm, d.f AS f, p.p * {dim} + row_number() OVER (PARTITION BY p.p ORDER BY {order('d.f', 'p.p')}, d.f) - 1 AS q FROM range({perms}) AS p(p), range({dim}) AS d(f)), "
        f"lay AS (SELECT perm, f, q // 8 AS bin, q % 8 AS pos FROM lay0 WHERE q // 8 < {hashes})"
    )


def winners(src: str, name: str = "win") -> str:
    return f"{name} AS (SELECT id, bin, pos, f FROM (SELECT x.id, l.bin, l.pos, l.f, row_number() OVER (PARTITION BY x.id, l.bin ORDER BY x.v DESC, l.perm, l.f) AS r FROM {src} x JOIN lay l ON x.f = l.f) WHERE r = 1)"


def probes(hashes: int) -> str:
    bits = max(1, math.ceil(math.log2(hashes)))
    return f"prb AS (SELECT b.b AS bin, a.a AS attempt, least((((a.a * ((b.b + 1) * 64 + 1)) % 4294967296) * 8 % 4294967296) // {1 << (32 - bits)}, {hashes - 1}) AS target FROM range({hashes}) AS b(b), range(1, {hashing.PROBES + 1}) AS a(a))"


def densified(sig: str, hashes: int, name: str = "den") -> str:
    """From (id, bin, h)."""
    return (
        f"{name}a AS (SELECT bin, target, min(attempt) AS attempt FROM (SELECT bin, target, attempt FROM prb UNION ALL SELECT b.b, b.b, 0 FROM range({hashes}) AS b(b)) GROUP BY ALL), "
        f"{name}o AS (SELECT s.id, a.bin, arg_min(s.h, a.attempt) AS h FROM {sig} s JOIN {name}a a ON a.target = s.bin GROUP BY ALL), "
        f"{name}f AS (SELECT i.id, b.b AS bin FROM (SELECT DISTINCT id FROM {sig}) i, range({hashes}) AS b(b)), "
        f"{name} AS (SELECT f.id, f.bin, CAST(coalesce(o.h, 0) AS BIGINT) AS h FROM {name}f f LEFT JOIN {name}o o ON f.id = o.id AND f.bin = o.bin)"
    )


def _product(a: str, b: int) -> str:
    return f"((({a})::UBIGINT * {b}::UBIGINT) % 4294967296::UBIGINT)"


def _turned(a: str, by: int) -> str:
    return f"((({a}) * {2**by}::UBIGINT) % 4294967296::UBIGINT + ({a}) // {2 ** (32 - by)}::UBIGINT)"


def murmur(src: str, seed: int, name: str = "mur") -> str:
    """(key, h) of a table (key, words, n): Murmur3 of n bytes given as 32-bit little-endian words, the last one filled up with zeros."""
    k = _product(_turned(_product("w", 0xCC9E2D51), 15), 0x1B873593)
    out = f"{name}0 AS (SELECT key, n, list_transform(words, lambda w: {k}) AS ks FROM {src}), "
    x = "xor(h, k)"
    step = f"(({_turned(x, 13)}) * 5::UBIGINT + {0xE6546B64}::UBIGINT) % 4294967296::UBIGINT"
    out += f"{name}1 AS (SELECT key, n, xor(xor(list_reduce(list_prepend({seed}::UBIGINT, ks[:n // 4]), lambda h, k: {step}), CASE WHEN n % 4 > 0 THEN ks[n // 4 + 1] ELSE 0::UBIGINT END), n::UBIGINT) AS h FROM {name}0), "
    out += f"{name}2 AS (SELECT key, {_product('xor(h, h // 65536::UBIGINT)', 0x85EBCA6B)} AS h FROM {name}1), "
    out += f"{name}3 AS (SELECT key, {_product('xor(h, h // 8192::UBIGINT)', 0xC2B2AE35)} AS h FROM {name}2), "
    return out + f"{name} AS (SELECT key, CAST(xor(h, h // 65536::UBIGINT) AS BIGINT) AS h FROM {name}3)"


def murmur_long(src: str, seed: int = 42, name: str = "mur") -> str:
    """(key, h) of the non-negative numbers in column key, as 8 bytes."""
    return f"{name}w AS (SELECT DISTINCT key, [(key % 4294967296)::UBIGINT, (key // 4294967296)::UBIGINT] AS words, 8 AS n FROM {src}), " + murmur(f"{name}w", seed, name)


def murmur_ascii(src: str, seed: int, name: str = "mur") -> str:
    """(key, h) of the ASCII texts in column key."""
    byte = "CASE WHEN 4 * i + {j} <= length(key) THEN ascii(substr(key, 4 * i + {j}, 1)) ELSE 0 END"
    word = " + ".join(f"({byte.format(j=j + 1)}) * {256**j}" for j in range(4))
    return f"{name}w AS (SELECT DISTINCT key, list_transform(range(0, (length(key) + 3) // 4), lambda i: ({word})::UBIGINT) AS words, length(key) AS n FROM {src} WHERE key IS NOT NULL), " + murmur(f"{name}w", seed, name)


def address(sig: str, k: int, l: int, bits: int = 2, name: str = "adr") -> str:  # noqa: E741
    return f"{name} AS (SELECT id, bin // {k} AS tbl, CAST(sum(h * CAST(power({2**bits}, {k - 1} - bin % {k}) AS BIGINT)) AS BIGINT) AS bucket FROM {sig} WHERE bin < {k * l} GROUP BY ALL)"


def bins(hashes: int, range_pow: int, dim: int) -> str:
    """mb (f, bin): the min-hash bin of each feature."""
    size = 1 << range_pow
    return f"mf AS (SELECT f AS key FROM range({dim}) AS t(f)), {murmur_long('mf')}, mb AS (SELECT key AS f, (h % {size}) // {math.ceil(size / hashes)} AS bin FROM mur)"


def srp(dim: int, hashes: int) -> str:
    keep = math.ceil(dim / 3)
    return (
        f"sg AS (SELECT bin, f, CASE WHEN ({order('f', 'bin')} // 7) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (SELECT b.b AS bin, d.f AS f, row_number() OVER (PARTITION BY b.b ORDER BY {order('d.f', 'b.b')}, d.f) AS r FROM range({hashes}) AS b(b), range({dim}) AS d(f)) WHERE r <= {keep})"
    )


def forward(src: str, w: str, name: str, relu: bool) -> str:
    """(id, f, v) or (record_id, node, z) from (id, f, v) and the layer `w`."""
    z = f"SELECT x.id AS id, w.node AS node, sum(w.w * x.v) AS s FROM {src} x JOIN {w}w w ON x.f = w.f GROUP BY ALL"
    if relu:
        return f"{name} AS (SELECT z.id, z.node AS f, greatest(z.s + b.b, 0.0) AS v FROM ({z}) z JOIN {w}b b ON z.node = b.node)"
    return f"{name} AS (SELECT z.id AS record_id, z.node, z.s + b.b AS z FROM ({z}) z JOIN {w}b b ON z.node = b.node)"


SOFTMAX = (
    "e0 AS (SELECT *, exp(z - greatest(max(z) OVER (PARTITION BY record_id), 0.0)) AS e FROM zz), "
    "pp AS (SELECT record_id, node, z, e / (sum(e) OVER (PARTITION BY record_id) + 1e-7::DOUBLE) AS p FROM e0)"
)


def delta(batch: str) -> str:
    return f"dd AS (SELECT p.record_id, p.node, (CASE WHEN t.label IS NOT NULL THEN 1.0 ELSE 0.0 END - p.p) / {batch} AS delta FROM pp p LEFT JOIN tgt t ON p.record_id = t.record_id AND p.node = t.label)"


def two_layers() -> str:
    """emb to pp: 64 features, 16 hidden nodes, 10 classes."""
    return f"{EMB}, {LABELS}, {layer('a', 0, 16, 64)}, {layer('c', 1, 10, 16)}, {forward('emb', 'a', 'hid', True)}, {forward('hid', 'c', 'zz', False)}, {SOFTMAX}"


BACK = (
    "hd AS (SELECT d.record_id, w.f AS node, sum(d.delta * w.w) AS delta FROM dd d JOIN cw w ON d.node = w.node GROUP BY ALL), "
    "hdd AS (SELECT h.* FROM hd h JOIN hid a ON a.id = h.record_id AND a.f = h.node WHERE a.v > 0)"
)


def uniform(src: str, seed: int, turn: int, name: str) -> str:
    """(id, f, u) of a table (id, f): the counter-based numbers of model.uniform."""
    word = 1 << 32
    out = f"{name}0 AS (SELECT id, f, (id % 2147483648 * 2654435761 % {word} + f % 2147483648 * 2246822519 % {word} + {(seed * 3266489917 + turn * 668265263) % word}) % {word} AS x FROM {src}), "
    for r in (1, 2):
        out += f"{name}{r} AS (SELECT id, f, xor(x, x // 65536) * 73244475 % {word} AS x FROM {name}{r - 1}), "
    return out + f"{name} AS (SELECT id, f, (xor(x, x // 65536) + 0.5::DOUBLE) / {word}::DOUBLE AS u FROM {name}2)"
