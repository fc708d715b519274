"""BPE as a tokenization automaton: encode by table-driven transitions, decode by emitting arc labels.

The token automaton has the tokens as states (the last one read) and as arcs.  It starts with every
base token allowed after every other.  Merge number m, (u, v) -> uv, is one gadget: a state uv that
copies the arcs of v, an arc to uv wherever there is one to u, and no arc v at u any more.  A token
sequence is an encoding exactly if the automaton accepts it, and each prefix of a word ends in
exactly one state.

Read letter by letter this is a deterministic automaton.  Its state is the longest end of the prefix
that a token could still begin with, and the token that ends at each place of that end; a letter
leads to the one token that ends with it and may follow, and so to the next state.  Encoding a word
is one table entry per letter and a walk back over the tokens.

Both tables are compiled as they are met: of the token automaton the full table has (vocabulary
size)**2 arcs, and an arc is filled in by following the copies back to the gadget that made or cut it;
the letter table is filled in by the first word that takes a transition.  Each is bounded and starts
again when full.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkloom.llm.batches import with_text_columns

END = "</w>"
#: Bytes of words and their encodings that one Python worker keeps, in each of two generations; longer
#: words than CACHE_WORD letters are not kept.  Entries of the letter table and of the arc table.
CACHE_BYTES, CACHE_WORD, TABLE, ARCS = 80 << 20, 256, 1_000_000, 1_000_000
#: What a kept word takes besides its letters and encodings.
_ENTRY = 300


def byte_letters() -> list[str]:
    """The printable stand-in for each byte: itself if printable in Latin-1, else U+0100 onwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_ONE = [bytes([b]) for b in range(256)]
_BYTES = {c: b for b, c in enumerate(byte_letters())}
#: Fixed values, for equal results: letters and numbers of later Unicode versions than the vocabulary's
#: library has, which it takes for symbols; and capitals that it lowers beyond Python's tables.
_LATER = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb \U00011de0-\U00011de9 \U00011df1 "
    "\U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff "
    "\U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 "
    "\U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 "
    "\U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
).split()
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_LOWERED = frozenset(map(chr, _LOWER))
_LATER_SET = frozenset(chr(c) for r in _LATER for c in range(ord(r[0]), ord(r[-1]) + 1))


#: In place of a token: the start of the word, and no token.
START, NONE = -2, -1


class MergeAutomaton:
    """merges: (left, right) strings in order of priority; ids: token string to id."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]):
        size = max(ids.values(), default=-1) + 1
        self.ids, self.size = ids, size
        self.labels = [""] * size
        for token, i in ids.items():
            self.labels[i] = token
        self.born, self.left, self.right, self.cut = [0] * size, [-1] * size, [-1] * size, {}
        for m, (u, v) in enumerate(merges, 1):
            a, b, ab = ids[u], ids[v], ids[u + v]
            if self.born[ab]:
                raise ValueError(f"two merges make {u + v!r}")
            if m <= max(self.born[a], self.born[b]):
                raise ValueError(f"a part of {u + v!r} is made after it")
            self.born[ab], self.left[ab], self.right[ab], self.cut[a * size + b] = m, a, b, m
        self.arcs: dict[int, bool] = {}
        # Letters are bytes from here on: tokens inside a word, and those that end one.
        self.inner, self.ending, self.sizes = {}, {}, [0] * size
        for token, i in ids.items():
            letters = token.removesuffix(END)
            if all(c in _BYTES for c in letters):
                raw = bytes(map(_BYTES.__getitem__, letters))
                (self.ending if token.endswith(END) else self.inner)[raw] = i
                self.sizes[i] = len(raw)
        self.begins = {t[:k] for t in self.inner for k in range(len(t))} | {t[:k] for t in self.ending for k in range(len(t) + 1)}
        self._restart()

    def _restart(self):
        """The letter table with its first state only: nothing read, and before it the start of the word."""
        self.states, self.numbers, self.last = [(b"", (START,))], {(b"", (START,)): 0}, [START]
        self.table: dict[int, int] = {}
        self.final: dict[int, int] = {}

    def allows(self, x: int, y: int) -> bool:
        """Is there an arc y at state x, after all gadgets?"""
        key = x * self.size + y
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._trace(x, y, len(self.labels) + len(self.cut))
        return found

    def _trace(self, x: int, y: int, time: int) -> bool:
        born, size, cut = self.born, self.size, self.cut
        while True:
            if cut.get(x * size + y, time + 1) <= time:
                return False
            bx, by = born[x], born[y]
            if bx > by:  # the arcs of uv are those of v before gadget bx cut any
                x, time = self.right[x], bx - 1
            elif by > bx:  # an arc uv stands where gadget by left an arc u
                y, time = self.left[y], by
            elif bx:
                x, y, time = self.right[x], self.left[y], bx - 1
            else:
                return True

    def _token(self, state: int, letter: int, end: bool) -> int:
        """The token that ends with the letter after the state; NONE if the vocabulary has none."""
        read, chain = self.states[state]
        read, tokens = read + _ONE[letter], self.ending if end else self.inner
        for k in range(len(chain) - 1, -1, -1):
            token = tokens.get(read[k:])
            if token is not None and (chain[k] == START or chain[k] != NONE and self.allows(chain[k], token)):
                return token
        return NONE

    def _step(self, state: int, letter: int) -> int:
        """The state after the letter, from now on in the table."""
        token = self._token(state, letter, False)
        read, chain = self.states[state]
        read, cut = read + _ONE[letter], 0
        while read[cut:] not in self.begins:
            cut += 1
        new = (read[cut:], (*chain, token)[cut:])
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
            self.last.append(token)
        self.table[state << 8 | letter] = number
        return number

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word; its last token has the end mark."""
        if not word:
            return []
        if len(self.table) + len(self.final) > TABLE:
            self._restart()
        table, state, path = self.table, 0, []
        for letter in word[:-1]:
            following = table.get(state << 8 | letter)
            state = following if following is not None else self._step(state, letter)
            path.append(state)
        key = state << 8 | word[-1]
        token = self.final.get(key)
        if token is None:
            token = self.final[key] = self._token(state, word[-1], True)
        out, at, sizes, last = [], len(word), self.sizes, self.last
        while True:
            if token == NONE:
                raise ValueError(f"the vocabulary lacks a letter of {word!r}")
            out.append(token)
            at -= sizes[token]
            if not at:
                return out[::-1]
            token = last[path[at - 1]]


class WordCoder:
    """The whole coder of a vocabulary file: normalise, split into words, run the automaton."""

    def __init__(self, spec: dict):
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.labels = dict(enumerate(self.automaton.labels))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if not t["normalized"]}
        self.labels |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
        self.words = regex.compile(pattern)
        later = "[" + "".join(_LATER) + "]"
        self.older = regex.compile(pattern.replace(r"\p{L}+", rf"(?:(?!{later})\p{{L}})+").replace(r"|\p{N}|", rf"|(?!{later})\p{{N}}|").replace(r"[^\p{White_Space}\p{L}\p{N}]+", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|{later})+"))
        coder = self

        class Words(dict):
            def __missing__(self, word):
                return coder._learn(word)

        self.known, self.old, self.kept = Words(), {}, 0

    def _learn(self, word: str) -> tuple[str, str]:
        """(ids, labels) of a word, each joined by spaces; kept in the younger generation."""
        found = self.old.get(word)
        if found is None:
            ids = self.automaton.encode(word.encode())
            found = " ".join(map(str, ids)), self.decode(ids)
        if len(word) > CACHE_WORD:
            return found
        self.kept += _ENTRY + 4 * len(word) + len(found[0]) + 4 * len(found[1])
        if self.kept > CACHE_BYTES:
            self.old, self.kept = dict(self.known), 0
            self.known.clear()
        self.known[word] = found
        return found

    def decode(self, ids) -> str:
        """The labels of the arcs, one space between two; the vocabulary has no other decoder."""
        return " ".join([self.labels[i] for i in ids if i in self.labels])

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() has a rule for the last letter
            if not _LOWERED.isdisjoint(text):
                text = text.translate(_LOWER)
            if not _LATER_SET.isdisjoint(text):
                return self.older.findall(text.lower())
        return self.words.findall(text.lower())

    def parts(self, text: str):
        """(special token or None, words) in order."""
        if self.cut is None or "<|" not in text:
            yield None, self.split(text)
            return
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                yield part, []
            elif part:
                yield None, self.split(part)

    def texts(self, text: str) -> tuple[str, str]:
        """(ids joined by one space, decoded text)."""
        ids, labels = [], []
        for special, words in self.parts(text):
            if special is not None:
                ids.append(str(self.special[special]))
                labels.append(special)
            elif words:
                a, b = zip(*map(self.known.__getitem__, words), strict=True)
                ids.append(" ".join(a))
                labels.append(" ".join(b))
        return " ".join(ids), " ".join(labels)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.texts(text)[0].split()]


_CODERS: dict[str, WordCoder] = {}


def coder_of(spec: str) -> WordCoder:
    """One coder per vocabulary and Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = WordCoder(json.loads(spec))
    return _CODERS[key]


def encode_documents(docs: DataFrame, vocabulary: str, *, text_col: str = "text", keep_text: bool = True, keep_ids: bool = False, keep_decoded: bool = False) -> DataFrame:
    """docs with n_tokens long, ids_sha256 and decoded_sha256 (ids and decoded on request).

    `vocabulary` is the path of a tokenizers JSON file, read on the driver and broadcast (its size is
    that of the file, whatever the input).  Null texts are empty: no tokens, digests of the empty
    string.  Rows are independent: repeated rows give equal results, an empty table an empty one;
    other columns pass through, those named like a result are replaced.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        coder = coder_of(spec.value)

        def go(column: pa.Array) -> list[pa.Array]:
            count, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for k in range(len(column)):
                ids, decoded = coder.texts(column[k].as_py() or "")
                count.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(np.array(ids.split(), np.int32))
                if keep_decoded:
                    all_text.append(decoded)
            out = [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            return out + ([pa.array(all_ids, pa.list_(pa.int32()))] if keep_ids else []) + ([pa.array(all_text, pa.string())] if keep_decoded else [])

        return go

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded
    return with_text_columns(docs, text_col, schema, make, keep_text)
