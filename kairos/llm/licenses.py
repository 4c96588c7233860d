"""License scans: template markup compiled to token automata.

A template is wording with SPDX-style markup: ``<<beginOptional>>`` and
``<<endOptional>>`` around words that may be missing, and
``<<var;name=...;min=a;max=b>>`` for a replaceable region of a to b words.
All templates are compiled into one automaton over words; a text matches a
template at a place if its mandatory wording stands there exactly. Subsets of
states are made into rows of a transition table as texts need them.

Words are lower-cased (A-Z) runs of anything but ASCII blanks, signs and
controls. A scan starts at every word that can open a template, and ends at
the table's dead state; replaceable regions are bounded, so a scan from one
place is too. For each place and label the longest match counts.

Defined cases: a null text counts as empty (no words, no match, score 0);
null doc_ids stay; repeated rows give repeated results; columns besides
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import pick

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")

# The phrases that any text is scanned for, with their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Notices and license texts as templates.
NOTICES = (
    ("apache-2.0", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following <<beginOptional>>conditions<<endOptional>>"),
    ("cc-by-4.0", "cc by 4 0 <<beginOptional>>international<<endOptional>>"),
    ("cc-by-nc", "cc by nc <<beginOptional>>4 0<<endOptional>>"),
    ("cc-by-nd", "cc by nd <<beginOptional>>4 0<<endOptional>>"),
    ("cc-by-sa", "cc by sa <<beginOptional>>4 0<<endOptional>>"),
    ("copyright", "copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;min=1;max=8>> all rights reserved"),
    ("gpl-2.0", "general public license <<beginOptional>>as published by the free software foundation either"
                "<<endOptional>> <<beginOptional>>gpl<<endOptional>> version 2"),
    ("gpl-3.0", "general public license <<beginOptional>>as published by the free software foundation either"
                "<<endOptional>> <<beginOptional>>gpl<<endOptional>> version 3"),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any "
            "purpose with or without fee is hereby granted"),
    ("lgpl", "lesser general public license"),
    ("mit", "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files <<beginOptional>>the software<<endOptional>> to deal in the "
            "<<var;name=work;min=1;max=3>> without restriction"),
    ("mpl-2.0", "subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>> "
                "<<beginOptional>>version<<endOptional>> 2 0"),
    ("no-copy", "no part of this <<var;name=work;min=1;max=4>> may be reproduced"),
)


@dataclass(frozen=True)
class Item:
    kind: str                 # word, optional, var
    word: str = ""
    inside: tuple = ()
    low: int = 0
    high: int = 0


@dataclass(frozen=True)
class Template:
    label: str
    items: tuple
    base: bool

    @property
    def mandatory(self) -> tuple[str, ...]:
        return tuple(i.word for i in self.items if i.kind == "word")

    @property
    def weight(self) -> float:
        """How much a match says: the more mandatory words, the more."""
        n = len(self.mandatory)
        return n / (n + 2)


def parse(markup: str) -> tuple[Item, ...]:
    """Markup to items; optional regions nest."""
    stack: list[list[Item]] = [[]]
    for i, piece in enumerate(MARK.split(markup)):
        if i % 2 == 0:
            words = WORD.findall(piece.encode().lower())
            stack[-1] += [Item("word", w.decode()) for w in words]
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional":
            if len(stack) == 1:
                raise ValueError(f"endOptional without beginOptional: {markup}")
            inside = tuple(stack.pop())
            stack[-1].append(Item("optional", inside=inside))
        else:
            given = dict(p.split("=", 1) for p in piece.split(";")[1:])
            stack[-1].append(Item("var", low=int(given["min"]), high=int(given["max"])))
    if len(stack) != 1:
        raise ValueError(f"beginOptional without endOptional: {markup}")
    return tuple(stack[0])


@lru_cache
def templates() -> tuple[Template, ...]:
    return tuple([Template(l, parse(m), True) for l, m in BASE] + [Template(l, parse(m), False) for l, m in NOTICES])


@dataclass
class Automaton:
    """Word automaton of many templates; ``step`` and ``accepts`` are its table, grown on demand."""

    arcs: list[dict] = field(default_factory=list)     # per state: word (None: any) to next states
    skips: list[set] = field(default_factory=list)     # per state: next states without a word
    ends: dict[int, int] = field(default_factory=dict)  # state to template number
    step: dict = field(default_factory=dict)
    accepts: dict = field(default_factory=dict)

    def state(self) -> int:
        self.arcs.append({})
        self.skips.append(set())
        return len(self.arcs) - 1

    def add(self, at: int, items: tuple) -> int:
        for it in items:
            to = self.state()
            if it.kind == "word":
                self.arcs[at].setdefault(it.word.encode(), set()).add(to)
            elif it.kind == "optional":
                self.skips[self.add(at, it.inside)].add(to)
                self.skips[at].add(to)
            else:
                for n in range(it.high + 1):
                    if n >= it.low:
                        self.skips[at].add(to)
                    if n < it.high:
                        more = self.state()
                        self.arcs[at].setdefault(None, set()).add(more)
                        at = more
            at = to
        return at

    def closed(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def compile(self, all_templates) -> None:
        start = self.state()
        for number, t in enumerate(all_templates):
            own = self.state()
            self.skips[start].add(own)
            self.ends[self.add(own, t.items)] = number
        self.start = self.closed({start})
        self.words = {w for a in self.arcs for w in a if w is not None}
        self.opening = {w for s in self.start for w in self.arcs[s]}
        if None in self.opening:
            raise ValueError("a template must open with a word")

    def row(self, states: frozenset, word: bytes | None) -> frozenset:
        """Next states; words of no template share one column (None)."""
        key = (states, word)
        if key not in self.step:
            to = {n for s in states for n in self.arcs[s].get(word, ())} if word is not None else set()
            to |= {n for s in states for n in self.arcs[s].get(None, ())}
            self.step[key] = nxt = self.closed(to)
            self.accepts[nxt] = tuple(sorted(self.ends[s] for s in nxt if s in self.ends))
        return self.step[key]

    def scan(self, words: list[bytes]):
        """(template number, start, end) of the longest match of each template at each place."""
        known, opening = self.words, self.opening
        for i, w in enumerate(words):
            if w not in opening:
                continue
            states, best = self.start, {}
            for j in range(i, len(words)):
                states = self.row(states, words[j] if words[j] in known else None)
                if not states:
                    break
                for number in self.accepts[states]:
                    best[number] = j + 1
            for number, end in best.items():
                yield number, i, end


@lru_cache
def automaton() -> Automaton:
    a = Automaton()
    a.compile(templates())
    return a


def find_matches(text: str | None) -> tuple[int, list[tuple[str, bool, int, int]]]:
    """Number of words and the matches (label, base, first word, end word) of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = WORD.findall(raw)
    # a text without some template's mandatory words holds none of its matches
    if not any(all(w.encode() in raw for w in t.mandatory) for t in templates()):
        return len(words), []
    found = [(templates()[n].label, templates()[n].base, i, j) for n, i, j in automaton().scan(words)]
    return len(words), sorted(found, key=lambda m: (m[2], m[0], m[3]))


MATCHES = "array<struct<label:string,base:boolean,start:bigint,end:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words`` and ``matches`` (label, base, start, end in words) of every text."""
    def work(batches):
        for b in batches:
            got = [find_matches(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "n_words": [n for n, _ in got],
                "matches": [[dict(label=l, base=x, start=i, end=j) for l, x, i, j in m] for _, m in got]})
    return pick(docs, "doc_id", "text").mapInPandas(work, f"doc_id long, n_words long, matches {MATCHES}")


def weights() -> dict[str, float]:
    out: dict[str, float] = {}
    for t in templates():
        out[t.label] = max(out.get(t.label, 0.0), t.weight)
    return out


def score(labels: Column) -> Column:
    """1 less the product of what each distinct label leaves in doubt."""
    left = F.lit(1.0)
    for label, w in weights().items():
        left = left * F.when(F.array_contains(labels, label), 1.0 - w).otherwise(1.0)
    return F.lit(1.0) - left
