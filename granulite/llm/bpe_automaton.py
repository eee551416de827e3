"""Byte-level BPE as a token automaton that grows by one gadget per merge; table-driven encoding, decoding by arc labels.

The automaton has one state per token (the last token read) and an arc t -> u labelled u wherever u may follow t in a BPE
result. It starts with the byte tokens, all arcs present. The gadget of merge (u, v) -> w

* removes the arc u -> v,
* gives w the arcs that v has (those before the removal if u = v), and
* adds an arc to w wherever there is one to u.

After all merges the automaton accepts exactly the BPE results, so a byte string spells one path, and so does each of its
prefixes. A full arc table over the vocabulary would take gigabytes, therefore the gadgets are kept as tables (removed arc ->
merge number; token -> merge number, parts) and an arc is unrolled through the gadgets that made it.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import cuts, give_back, per_worker
from granulite.llm.pretokens import Memo, chunks_of, piece_pattern

#: Bytes of a piece up to which pieces of equal length are encoded side by side.
SHORT = 48
#: Text encoded at a time.
BATCH_BYTES = 2_000_000
#: Slots for arcs that a worker keeps.
ARCS = 1 << 19
#: Chunks whose ids a worker keeps.
MEMO = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable bytes stand for themselves, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges: gadget tables, a byte trie of the token labels, and the labels by id."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, pre = said["model"], said.get("pre_tokenizer") or {}
        if (model["type"] != "BPE" or said.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout")):
            raise ValueError("the automaton takes a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        letters = byte_letters()
        added = {a["content"]: a["id"] for a in said.get("added_tokens", [])}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in said.get("added_tokens", [])):
            raise ValueError("added tokens must match plainly")
        self.added = regex.compile("|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None
        self.added_ids = added
        self.piece = regex.compile(piece_pattern(pattern))
        size = max([*vocab.values(), *added.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            # added tokens decode as their text
            self.labels[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in added.items():
            self.labels[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make one token")
        self.size = size
        self.lengths = np.array([len(x) for x in self.labels], np.int64)
        self.number = np.full(size, -1, np.int64)  # merge that made a token; -1 for bytes
        self.first, self.second = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.number[made], self.first[made], self.second[made] = np.arange(len(made)), left, right
        arcs = left * size + right
        order = np.argsort(arcs)
        self.gone, self.gone_at = arcs[order], order  # removed arcs, sorted, and the merge that removes each
        tokens = [*sorted({vocab[c] for c in letters if c in vocab}), *made.tolist()]
        self._trie(tokens)
        self.memo: Memo = Memo(MEMO)
        # arcs met so far, one a slot, so that frequent ones need no unrolling
        self.met = np.full(ARCS, -(1 << 62), np.int64)
        self.met_is = np.zeros(ARCS, bool)

    def _trie(self, tokens: list[int]) -> None:
        step: dict[int, int] = {}
        ends: list[int] = [-1]
        for t in tokens:
            node = 0
            for byte in self.labels[t]:
                k = node << 8 | byte
                to = step.get(k)
                if to is None:
                    to = step[k] = len(ends)
                    ends.append(-1)
                node = to
            ends[node] = t
        self.step = step
        keys = np.fromiter(step.keys(), np.int64, len(step))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(step.values(), np.int64, len(step))[order]
        self.root = np.full(256, -1, np.int64)
        for byte in range(256):
            self.root[byte] = step.get(byte, -1)
        self.ends = np.array(ends, np.int64)

    def next_node(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        k = node << 8 | byte
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == k, self.to[at], -1)

    def arcs(self, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Whether the arcs t -> u exist once all gadgets are in place; t = -1 is the start, which has all arcs."""
        out = np.ones(len(t), bool)
        asked = t * self.size + u
        slot = (asked ^ asked >> 17) & (ARCS - 1)
        known = self.met[slot] == asked
        out[known] = self.met_is[slot[known]]
        todo = np.flatnonzero(~known & (t >= 0))
        out[todo] = self._unroll(t[todo], u[todo])
        self.met[slot[todo]], self.met_is[slot[todo]] = asked[todo], out[todo]
        return out

    def _unroll(self, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        out = np.ones(len(t), bool)
        live = np.arange(len(t))
        before = np.full(len(live), len(self.gone), np.int64)  # only gadgets below this number count
        while len(live):
            k = t * self.size + u
            at = np.searchsorted(self.gone, k)
            at[at == len(self.gone)] = 0
            cut = (self.gone[at] == k) & (self.gone_at[at] < before)
            out[live[cut]] = False
            nt, nu = self.number[t], self.number[u]
            go = ~cut & ((nt >= 0) | (nu >= 0))
            # the later token's gadget made the arc: from an arc to its first part, or from an arc of its second part
            to = nu >= nt
            before = np.where(to, np.minimum(before, nu + 1), np.minimum(before, nt))
            t, u = np.where(to, t, self.second[t]), np.where(to, self.first[u], u)
            live, t, u, before = live[go], t[go], u[go], before[go]
        return out

    def arc(self, t: int, u: int) -> bool:
        return bool(self.arcs(np.array([t]), np.array([u]))[0])

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (little-endian, 32 bits): the one path through the automaton that spells it."""
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        for n, rows in by_length.items():
            if n > SHORT:
                for i in rows:
                    out[i] = self._encode_long(pieces[i])
                continue
            m = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8).reshape(len(rows), n).astype(np.int64)
            last = np.full((len(rows), n + 1), -1, np.int64)
            for i in range(n):
                at = np.arange(len(rows))
                node = self.root[m[:, i]]
                for j in range(i, n):
                    if j > i:
                        node = self.next_node(node, m[at, j])
                    alive = node >= 0
                    at, node = at[alive], node[alive]
                    if not len(at):
                        break
                    token = self.ends[node]
                    has = np.flatnonzero(token >= 0)
                    ok = has[self.arcs(last[at[has], i], token[has])]
                    last[at[ok], j + 1] = token[ok]
            # walk back from the end
            place, back = np.full(len(rows), n), []
            while (place > 0).any():
                t = np.where(place > 0, last[np.arange(len(rows)), place], -1)
                back.append(t)
                place = place - np.where(t >= 0, self.lengths[t], 0)
            path = np.array(back[::-1]).T.reshape(len(rows), -1)
            there = path >= 0
            flat, end = path[there].astype("<u4").tobytes(), (4 * np.cumsum(there.sum(1))).tolist()
            for i, x, y in zip(rows, [0, *end], end):
                out[i] = flat[x:y]
        return out

    def _encode_long(self, piece: bytes) -> bytes:
        """The same for one long piece, byte by byte, with the arcs met so far kept."""
        n, known = len(piece), {}
        last = [-1] * (n + 1)
        for i in range(n):
            node, t = 0, last[i]
            for j in range(i, n):
                node = self.step.get(node << 8 | piece[j], -1)
                if node < 0:
                    break
                u = int(self.ends[node])
                if u < 0:
                    continue
                k = t * self.size + u
                ok = known.get(k)
                if ok is None:
                    ok = known[k] = self.arc(t, u)
                if ok:
                    last[j + 1] = u
        path, i = [], n
        while i:
            path.append(last[i])
            i -= len(self.labels[last[i]])
        return np.array(path[::-1], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[str] = []
        plan: list[list[tuple[bool, int | bytes]]] = []
        for t in texts:
            p: list = []
            at = 0
            for m in self.added.finditer(t) if self.added is not None else ():
                p += [(True, len(parts)), (False, np.array([self.added_ids[m[0]]], "<u4").tobytes())]
                parts.append(t[at:m.start()])
                at = m.end()
            p.append((True, len(parts)))
            parts.append(t[at:])
            plan.append(p)
        self.memo.room()
        split, new = chunks_of(parts, self.memo)
        cut = [self.piece.findall(c) for c in new]
        fresh = list({p for c in cut for p in c})
        ids = dict(zip(fresh, self.encode_pieces([p.encode() for p in fresh])))
        self.memo.update((c, b"".join(map(ids.__getitem__, ps))) for c, ps in zip(new, cut))
        done = [b"".join(map(self.memo.__getitem__, s)) for s in split]
        return [b"".join(done[x] if of_text else x for of_text, x in p) for p in plan]

    def decode(self, ids: np.ndarray) -> str:
        """Labels of the arcs; bytes that are no UTF-8 become replacement marks."""
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


def automaton(path: str, pattern: str) -> Automaton:
    return per_worker(("automaton", path, pattern), lambda: Automaton(path, pattern))


def _coder(path: str, pattern: str, ids: bool):
    def code(batches):
        a = automaton(path, pattern)
        for batch in batches:
            for lo, n in cuts(batch.column(1), BATCH_BYTES):
                texts = [x or "" for x in batch.column(1).slice(lo, n).to_pylist()]
                found = a.encode(texts)
                cols = [batch.column(0).slice(lo, n), pa.array([len(x) // 4 for x in found], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                        pa.array([hashlib.sha256(a.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in found])]
                names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
            give_back()
    return code


def _decoder(path: str, pattern: str):
    def back(batches):
        a = automaton(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.decode(np.asarray(x, np.int64)) if x is not None else None for x in batch.column(1).to_pylist()], pa.string())], ["key", "text"])
    return back


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per row: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, on demand, ``ids``.

    Ids equal those of the tokenizers library without added special tokens; special strings in a text are special tokens, as
    by default. The digests are of the ids as little-endian unsigned 32-bit integers, and of the text decoded from them. No shuffle:
    each task compiles the automaton once per worker and keeps a bounded number of chunks. A null text is
    an empty one; repeated ids give a row each; extra columns are dropped; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(_coder(path, pattern, ids), schema).withColumnRenamed("key", id_col)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of each row of ids; null ids give a null text."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids")).mapInArrow(_decoder(path, pattern), f"key {kind}, text string").withColumnRenamed("key", id_col)
