"""BPE as a tokenization automaton: merges become gadgets, words walk its transitions, decoding emits arc labels.

The automaton. Its states are the last token read (start: none); an arc
``p -t-> t`` says that token t may follow state p in a correct tokenization.
It starts universal over the base symbols. Merge number m of the list, (u, v)
giving w, adds a gadget on every path ``p -u-> q -v-> r``: an arc ``p -w-> r``,
and q (the state after u) loses its v-arc, so that u can't be followed by v
where the merge would have fired. w's state starts as a copy of v's. A state
thus needs only the number at which it lost each arc (``lost``) and, per
token, the number of the merge that made it (``born``): an arc exists iff no
loss lies within the lives of the state and of the label, which ``_arc``
reads off the copies a state goes back to (last parts of p) and the arcs a
label was copied from (first parts of t). Arcs are put into the transition
table when first needed; the table is bounded.

The automaton is deterministic over tokens and every string of symbols has
exactly one accepted path. Labels are spelled by a second table, node and
symbol to node, compiled once: from a position it is driven symbol by symbol
and names the labels that start there. Encoding follows the longest that the
state has an arc for and, at a dead end, goes back to the next shorter; no
position is entered twice, which keeps it linear in the word.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from operator import itemgetter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from kairos.llm.common import pick

NEVER = 1 << 60
INNER, FINAL = "inner", "final"  # symbols are single characters
NO_ARCS: dict = {}
MAX_WORDS = 150_000     # encoded words of one generation; a task keeps two
MAX_ARCS = 1_000_000    # arcs kept per task
MAX_CACHED_WORD = 64    # longer words are encoded each time
MAX_OUT = 250_000       # tokens put out at a time


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TokenAutomaton:
    """Built from a vocabulary (token to id), merges in order, and the suffix of a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.born: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.lost: dict[str, dict[str, int]] = {}
        for number, (u, v) in enumerate(merges):
            self._gadget(number, u, v)
        # the spelling table: a node is a row of it, symbol to node. INNER holds the labels that start the node's spelling,
        # shortest first; FINAL those if a word ends there, where the last label carries the suffix
        self.start: dict = {INNER: (), FINAL: ()}
        self.longest = max(map(len, vocab), default=0)
        ends: list[tuple[dict, str]] = []
        for t in sorted(vocab, key=len):
            if self._made(t):
                at_end = t.endswith(suffix)
                node = self.start
                for x in t.removesuffix(suffix) if at_end else t:
                    node = node.setdefault(x, {})
                if at_end:
                    ends.append((node, t))
                else:
                    node["own"] = t
        todo = [self.start]
        while todo:
            node = todo.pop()
            shorter = node[INNER]
            for x, to in node.items():
                if len(x) == 1:
                    to[FINAL] = shorter
                    to[INNER] = shorter + (to.pop("own"),) if "own" in to else shorter
                    todo.append(to)
        for node, t in ends:
            node[FINAL] += (t,)
        self.arcs: dict[str, dict[str, bool]] = {}  # transition table: state, then label
        self.n_arcs = 0

    def _made(self, t: str) -> bool:
        return t in self.parts or len(t) == 1 or len(t) == 1 + len(self.suffix) and t.endswith(self.suffix)

    def _gadget(self, number: int, u: str, v: str) -> None:
        if not (self._made(u) and self._made(v) and self._arc(u, v)):
            return  # no path to merge: a label that never arises, or earlier merges keep v from standing after u
        self.lost.setdefault(u, {})[v] = number
        self.parts[u + v] = (u, v)
        self.born[u + v] = number

    def _arc(self, state: str, label: str) -> bool:
        ends = NEVER
        s = state
        while True:
            lost = self.lost.get(s)
            if lost:
                until, t = NEVER, label
                while True:
                    number = lost.get(t)
                    # the loss counts while the state and the arc it was copied from still stood alone; a merge that
                    # made the label itself comes first, as equal merges fire from the left
                    if number is not None and number < ends and number <= until:
                        return False
                    if t not in self.parts:
                        break
                    until, t = self.born[t], self.parts[t][0]
            if s not in self.parts:
                return True
            ends, s = self.born[s], self.parts[s][1]

    def follows(self, state: str, label: str) -> bool:
        """Whether ``label`` may follow ``state``, put into the transition table."""
        if self.n_arcs >= MAX_ARCS:
            self.arcs.clear()
            self.n_arcs = 0
        self.n_arcs += 1
        known = self.arcs.setdefault(state, {})[label] = self._arc(state, label)
        return known

    def labels_from(self, word: str, at: int) -> tuple[str, ...]:
        """Every label that spells ``word`` from ``at``, shortest first."""
        node = self.start
        for x in word[at:at + self.longest]:
            if x not in node:
                return node[INNER]
            node = node[x]
        return node[FINAL] if len(word) - at <= self.longest else node[INNER]

    def encode_word(self, word: str) -> list[str]:
        """The labels of the accepted path that spells ``word``, given in byte symbols."""
        n, at, path, dead = len(word), 0, [], set()
        left: list[tuple] = []  # per label of the path: the labels at its place and how many are still to try
        labels_from = self.labels_from
        tries = labels_from(word, 0)
        arcs, state, row, i = self.arcs, None, None, len(tries)
        while at < n:
            while i:
                i -= 1
                label = tries[i]
                if state is not None:
                    known = row.get(label)
                    if not (self.follows(state, label) if known is None else known):
                        continue
                to = at + len(label)
                if to > n:
                    to = n
                if dead and to in dead:
                    continue
                path.append(label)
                left.append((tries, i))
                at, state, row = to, label, arcs.get(label, NO_ARCS)
                if at < n:
                    tries = labels_from(word, at)
                    i = len(tries)
                break
            else:
                if not path:
                    return []  # a symbol that no label spells
                dead.add(at)  # only one path leads here, and it goes no further
                at -= len(path.pop())  # no label with the suffix: the word would be done
                state, (tries, i) = path[-1] if path else None, left.pop()
                row = arcs.get(state, NO_ARCS)
        return path


class WordTable(dict):
    """Word to (number of tokens, ids text, text decoded from the ids); a missing word walks the automaton.

    Beyond ``MAX_WORDS`` words the table starts anew, and words come over
    from the one before when they are met again; frequent words so stay.
    """

    def __init__(self, automaton: TokenAutomaton, decode):
        super().__init__()
        self.automaton, self.decode = automaton, decode
        self.before: dict = {}
        self.shown = {t: str(i) for t, i in automaton.vocab.items()}
        self.symbols = str.maketrans({chr(b): s for b, s in byte_symbols().items()})

    def __missing__(self, word: str):
        got = self.before.get(word) or self._walk(word)
        if len(word) <= MAX_CACHED_WORD:
            if len(self) >= MAX_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = got
        return got

    def _walk(self, word: str) -> tuple[int, str, str]:
        if word.isascii() and word.isprintable():
            symbols = word  # printable bytes stand for themselves
        else:
            symbols = word.encode().decode("latin-1").translate(self.symbols)
        path = self.automaton.encode_word(symbols)
        return len(path), " ".join([self.shown[t] for t in path]), self.decode([self.automaton.vocab[t] for t in path])


class Tokenizer:
    """Text to ids and back by a tokenizer file's rules: special tokens, NFC, lower case, split, automaton."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.words = WordTable(TokenAutomaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"]), self.decode)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") \
            if self.specials else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace(r"\s", BLANKS)
        self.split = regex.compile(pattern)
        # the same with the newer letters and numbers among everything else
        older = [(r"[\p{L}]", rf"[\p{{L}}--[{NEWER}]]"), (r"[\p{N}]", rf"[\p{{N}}--[{NEWER}]]"),
                 (rf"[^{BLANKS}\p{{L}}\p{{N}}]", rf"[[^{BLANKS}\p{{L}}\p{{N}}]||[{NEWER}]]")]
        newer = pattern
        for now, then in older:
            newer = newer.replace(now, then)
        self.split_newer, self.rare = regex.compile("(?V1)" + newer), re.compile(f"[{NEWER}{''.join(map(chr, LOWER))}]")
        # the same for texts of the first 256 code points, whose classes are listed
        for name in "LN":
            pattern = pattern.replace(rf"\p{{{name}}}", "".join(c for c in map(chr, range(256)) if regex.match(rf"\p{{{name}}}", c)))
        self.split_latin = re.compile(pattern)
        self.labels = {i: t for t, i in (model["vocab"] | self.specials).items()}

    def encode(self, text: str) -> list[tuple[int, str, str]]:
        """Per word or special token: number of tokens, ids text, text decoded from the ids."""
        if self.special is None or "<|" not in text:
            return self._plain(text)
        out: list[tuple[int, str, str]] = []
        for piece in self.special.split(text):
            out += [(1, str(self.specials[piece]), self.decode([self.specials[piece]]))] if piece in self.specials else self._plain(piece)
        return out

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        split = self.split_latin
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                # one lower case per character, whatever stands around it
                split, text = self.split, text.replace("Σ", "σ")
                if self.rare.search(text):
                    split, text = self.split_newer, text.translate(LOWER)
        return list(map(self.words.__getitem__, split.findall(text.lower())))

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels, joined by blanks: the file names no decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


#: Fixed value: the white space that the splitting pattern's \\s stands for, as a set's inside.
BLANKS = r"\t-\r\x20\x85\xa0  -     　"

#: What is a letter or a number to the regex module, but neither to the tokenizers library, whose
#: classes are those of Unicode 16.
NEWER_RANGES = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
NEWER = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER_RANGES.split())
#: Lower case of the capitals that Unicode 16 and 17 added.
LOWER = ({0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
         | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)})

_LOADED: dict[str, Tokenizer] = {}


def tokenizer(spec_text: str) -> Tokenizer:
    """The tokenizer of a specification, compiled once per Python worker."""
    key = hashlib.sha256(spec_text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(json.loads(spec_text))
    return _LOADED[key]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, spec_text: str, with_ids: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_tokens``, digests of ids and decoded text and, on demand, ``ids`` themselves.

    ``spec_text`` is a tokenizer file's JSON text; it is broadcast, and its
    size does not depend on the data. A null text counts as empty (no tokens);
    a null doc_id stays; repeated rows give repeated results; columns besides
    doc_id and text are ignored; an empty table gives an empty result.
    """
    spec = docs.sparkSession.sparkContext.broadcast(spec_text)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else [])

    def frame(rows):
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    def work(batches):
        tok = tokenizer(spec.value)
        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"]):
                got = tok.encode(text) if text else []
                # words are decoded from their ids when they are first met
                ids, decoded = (" ".join(map(itemgetter(i), got)) for i in (1, 2))
                n = sum(map(itemgetter(0), got))
                row = [None if doc_id is pd.NA else doc_id, n, _digest(ids), _digest(decoded)]
                rows.append(row + [np.array(ids.split(), np.int32)] if with_ids else row)
                size += n
                if size >= MAX_OUT:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return pick(docs, "doc_id", "text").mapInPandas(work, schema)


def decode(rows: DataFrame, spec_text: str) -> DataFrame:
    """``doc_id`` and ``ids`` to ``doc_id`` and ``text``: the labels that the ids name. Null ids give an empty text."""
    spec = rows.sparkSession.sparkContext.broadcast(spec_text)

    def work(batches):
        tok = tokenizer(spec.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"),
                                "text": [tok.decode(list(i)) if i is not None else "" for i in b["ids"]]})
    return pick(rows, "doc_id", "ids").mapInPandas(work, "doc_id long, text string")
