"""License scans by ordered signature rules.

A rule is a regex with a label, a priority, and keywords one of which every match holds; the
regex is tried only on texts with one.  Rules come from families: each family is written by hand as a
name pattern, versions and forms (notice, name with version, identifier, address), from which
the regexes are put together.  Detections that lie inside another one of higher priority, or
of the same priority and longer, are suppressed.  Base phrases are words standing
consecutively; they are reported apart and never suppressed.

Only a map over documents; a text without any keyword costs a few substring searches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelquilt.llm.decontaminate import _WORD_BYTES

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_BASE = re.compile(rb"(?<![^ ])(mit +license|apache +license|general +public +license)(?![^ ])")
_BASE_LABEL = {k.replace(" ", "").encode(): v for k, v in BASE.items()}

#: Blanks for all but ASCII, which may be white space or quotes around a keyword.
_ASCII = bytes(range(128)) + b" " * 128


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float
    inside: bool = False  # may start within a word


_GAP = r"[\s,;:()\"'*/#-]+"


def _spaced(name: str) -> str:
    return _GAP.join(re.escape(w) for w in name.split())


def _versioned(label: str, names: list[str], short: list[str], versions: list[str], keywords: tuple[str, ...], sites: list[str] = ()) -> Iterator[Rule]:
    """Rules of a family with versions: full name, short name, identifier, with "or later", address."""
    name = "(?:" + "|".join(_spaced(n) for n in names) + ")"
    brief = "(?:" + "|".join(re.escape(s) for s in short) + ")"
    for v in versions:
        number = re.escape(v.removesuffix(".0")) + (r"(?:\.0)?" if v.endswith(".0") else "")
        edge = r"(?![\w]|\.\d)"
        yield Rule(f"{label}-{v}", rf"{name}{_GAP}(?:as published by .{{1,80}}?{_GAP})?(?:either )?(?:version |ver\.? ?|v\.? ?)?{number}{edge}", keywords, 70, 0.9, True)
        yield Rule(f"{label}-{v}-or-later", rf"{name}.{{0,160}}?(?:version |v\.? ?){number}{_GAP}(?:of the licen[cs]e{_GAP})?or{_GAP}(?:\(at your option\){_GAP})?(?:any )?later", keywords, 80, 0.95, True)
        yield Rule(f"{label}-{v}", rf"\b{brief}[ -]?(?:version |v\.? ?)?{number}{edge}", tuple(s.lower() for s in short), 60, 0.7)
        yield Rule(f"{label}-{v}", rf"spdx-license-identifier:\s*{brief}-?{number}(?:-only)?(?![\w+]|-or)", ("spdx-license-identifier",), 95, 1.0, True)
        yield Rule(f"{label}-{v}-or-later", rf"spdx-license-identifier:\s*{brief}-?{number}(?:\+|-or-later)", ("spdx-license-identifier",), 95, 1.0, True)
    yield Rule(label, rf"\b{name}\b", keywords, 40, 0.6)
    for s in sites:
        yield Rule(label, s, (s.replace("\\", "").split("(")[0].split("[")[0],), 65, 0.85)


def _plain(label: str, names: list[str], ids: list[str], keywords: tuple[str, ...], notices: list[str] = (), sites: list[str] = ()) -> Iterator[Rule]:
    """Rules of a family without versions: licensing phrase, name, identifier, notice texts, address."""
    name = "(?:" + "|".join(_spaced(n) for n in names) + ")"
    yield Rule(label, rf"(?:licensed|released|distributed|available|published){_GAP}under{_GAP}(?:the{_GAP}|an?{_GAP})?(?:terms{_GAP}of{_GAP}(?:the{_GAP})?)?{name}", keywords, 75, 0.95)
    yield Rule(label, rf"\b{name}\b", keywords, 50, 0.6)
    for i in ids:
        yield Rule(label, rf"spdx-license-identifier:\s*{re.escape(i)}(?![\w.+-])", ("spdx-license-identifier",), 95, 1.0, True)
    for n in notices:
        first = max(re.sub(r"[^a-z ]", " ", n.replace("\\b", " ")).split(), key=len)
        yield Rule(label, r"[\s*#/;-]+".join(n.split()), (first,), 90, 1.0, True)
    for s in sites:
        yield Rule(label, s, (s.replace("\\", "").split("(")[0].split("[")[0],), 65, 0.85)


def rules() -> list[Rule]:
    """All rules, highest priority first."""
    out: list[Rule] = []
    gnu = ["1.0", "2.0", "3.0"]
    out += _versioned("gpl", ["gnu general public license", "gnu gpl", "general public licence"], ["gpl"], gnu, ("gpl", "general public"), [r"gnu\.org/licenses/(?:old-licenses/)?gpl"])
    out += _versioned("lgpl", ["gnu lesser general public license", "lesser general public license", "gnu library general public license", "gnu lgpl"], ["lgpl"], ["2.0", "2.1", "3.0"], ("lgpl", "general public"), [r"gnu\.org/licenses/(?:old-licenses/)?lgpl"])
    out += _versioned("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl"], ["agpl"], ["1.0", "3.0"], ("agpl", "general public"), [r"gnu\.org/licenses/agpl"])
    out += _versioned("gfdl", ["gnu free documentation license"], ["gfdl"], ["1.1", "1.2", "1.3"], ("free documentation",), [r"gnu\.org/licenses/fdl"])
    out += _versioned("apache", ["apache license", "apache software license"], ["apache"], ["1.0", "1.1", "2.0"], ("apache",), [r"apache\.org/licenses/license"])
    out += _versioned("mpl", ["mozilla public license"], ["mpl"], ["1.0", "1.1", "2.0"], ("mozilla",), [r"mozilla\.org/mpl"])
    out += _versioned("epl", ["eclipse public license"], ["epl"], ["1.0", "2.0"], ("eclipse",), [r"eclipse\.org/legal/epl"])
    out += _versioned("eupl", ["european union public licence", "european union public license"], ["eupl"], ["1.0", "1.1", "1.2"], ("european union",))
    out += _versioned("cddl", ["common development and distribution license"], ["cddl"], ["1.0", "1.1"], ("common development",))
    out += _versioned("cpl", ["common public license"], ["cpl"], ["1.0"], ("common public",))
    out += _versioned("osl", ["open software license"], ["osl"], ["1.0", "2.0", "2.1", "3.0"], ("open software",))
    out += _versioned("afl", ["academic free license"], ["afl"], ["1.1", "1.2", "2.0", "2.1", "3.0"], ("academic free",))
    out += _versioned("artistic", ["artistic license"], ["artistic"], ["1.0", "2.0"], ("artistic",))
    out += _versioned("bsl", ["boost software license"], ["bsl"], ["1.0"], ("boost software",), [r"boost\.org/license_1_0"])
    out += _versioned("busl", ["business source license"], ["busl"], ["1.1"], ("business source",))
    out += _versioned("ofl", ["sil open font license", "open font license"], ["ofl"], ["1.0", "1.1"], ("open font",), [r"scripts\.sil\.org/ofl"])
    out += _versioned("lppl", ["latex project public license"], ["lppl"], ["1.0", "1.1", "1.2", "1.3"], ("latex project",))
    out += _versioned("zpl", ["zope public license"], ["zpl"], ["1.1", "2.0", "2.1"], ("zope public",))
    out += _versioned("ecl", ["educational community license"], ["ecl"], ["1.0", "2.0"], ("educational community",))
    out += _versioned("sspl", ["server side public license"], ["sspl"], ["1.0"], ("server side public",))
    out += _versioned("ms-pl", ["microsoft public license"], ["ms-pl"], ["1.0"], ("microsoft public",))
    for code, words in (("by", "attribution"), ("by-sa", "attribution-sharealike"), ("by-nc", "attribution-noncommercial"), ("by-nd", "attribution-noderivs"), ("by-nc-sa", "attribution-noncommercial-sharealike"), ("by-nc-nd", "attribution-noncommercial-noderivs")):
        full = "creative commons " + words.replace("-", " ")
        out += _versioned(f"cc-{code}", [full, full + " license"], [f"cc-{code}", f"cc {code}"], ["2.0", "2.5", "3.0", "4.0"], ("creative commons",), [rf"creativecommons\.org/licenses/{code}/"])
    out += _plain("mit", ["mit license", "mit licence", "expat license", "x11 license"], ["MIT".lower(), "x11"], ("licen",), ["permission is hereby granted, free of charge, to any person obtaining a copy"], [r"opensource\.org/licenses/mit"])
    out += _plain("bsd", ["bsd license", "bsd licence", "bsd-style license", "new bsd license", "simplified bsd license", "modified bsd license"], ["0bsd"], ("bsd",), ["redistribution and use in source and binary forms, with or without modification"], [r"opensource\.org/licenses/bsd"])
    for n, word in (("2", "two"), ("3", "three"), ("4", "four")):
        out += _plain(f"bsd-{n}-clause", [f"bsd {n}-clause", f"{n}-clause bsd", f"bsd-{n}-clause", f"{word}-clause bsd"], [f"bsd-{n}-clause"], ("clause",))
    out += _plain("isc", ["isc license", "isc licence"], ["isc"], ("isc",), ["permission to use, copy, modify, and/or distribute this software for any purpose"])
    out += _plain("zlib", ["zlib license", "zlib/libpng license"], ["zlib"], ("zlib",), ["this software is provided 'as-is', without any express or implied warranty"])
    out += _plain("unlicense", ["the unlicense"], ["unlicense"], ("unlicense",), ["this is free and unencumbered software released into the public domain"], [r"unlicense\.org"])
    out += _plain("cc0", ["cc0 1.0 universal", "creative commons zero", "cc0"], ["cc0-1.0"], ("cc0", "creative commons zero"), (), [r"creativecommons\.org/publicdomain/zero"])
    out += _plain("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["wtfpl"], ("wtfpl", "what the fuck you want"))
    out += _plain("public-domain", ["public domain"], [], ("public domain",))
    out += _plain("postgresql", ["postgresql license"], ["postgresql"], ("postgresql",))
    out += _plain("python", ["python software foundation license", "psf license"], ["psf-2.0", "python-2.0"], ("license",))
    out += _plain("ruby", ["ruby license"], ["ruby"], ("ruby",))
    out += _plain("php", ["php license"], ["php-3.01"], ("php",))
    out += _plain("openssl", ["openssl license"], ["openssl"], ("openssl",))
    out += _plain("vim", ["vim license"], ["vim"], ("vim",))
    out += _plain("ncsa", ["university of illinois/ncsa open source license"], ["ncsa"], ("ncsa",))
    out += _plain("all-rights-reserved", ["all rights reserved"], [], ("all rights reserved",))
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern))


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Rule


class Scanner:
    """Rules gated by their keywords, with overlapping detections resolved."""

    def __init__(self, ordered: list[Rule] | None = None):
        self.ordered = rules() if ordered is None else ordered
        self.compiled = [re.compile(r.pattern, re.DOTALL) for r in self.ordered]
        #: Names are looked for in the words between single blanks, at the start of one where
        #: the rule asks for that; addresses anywhere in the text.
        self.names: dict[bytes, list[int]] = {}
        self.strings: dict[str, list[int]] = {}
        for i, r in enumerate(self.ordered):
            for k in r.keywords:
                if re.fullmatch(r"[a-z0-9 -]+", k):
                    self.names.setdefault(b" " * (not r.inside) + k.replace("-", " ").encode(), []).append(i)
                else:
                    self.strings.setdefault(k, []).append(i)

    def detect(self, text: str, flat: bytes | None = None) -> list[Detection]:
        """Detections in a lower-cased text that no other one contains, in order.

        flat: the text's words between single or more blanks, if at hand.
        """
        flat = text.encode().translate(_WORD_BYTES) if flat is None else flat
        flat = b" " + b" ".join((flat if flat.isascii() else flat.translate(_ASCII)).split())
        tried = {i for k, own in self.names.items() if k in flat for i in own}
        tried = sorted(tried.union(*(own for k, own in self.strings.items() if k in text)))
        found = [Detection(m.start(), m.end(), self.ordered[i]) for i in tried for m in self.compiled[i].finditer(text)]
        found.sort(key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.label))
        reach, kept = Reach({d.start for d in found}), []
        for d in found:
            if reach.upto(d.start) < d.end:
                kept.append(d)
                reach.add(d.start, d.end)
        return sorted(kept, key=lambda d: (d.start, d.end))


class Reach:
    """The farthest end of all intervals that begin at a place or before it, in a tree over the starts:
    n intervals take n log n steps, however they overlap."""

    def __init__(self, starts: set[int]):
        self.at = {s: i for i, s in enumerate(sorted(starts), 1)}
        self.best = [-1] * (len(self.at) + 1)

    def add(self, start: int, end: int) -> None:
        i = self.at[start]
        while i < len(self.best):
            self.best[i] = max(self.best[i], end)
            i += i & -i

    def upto(self, start: int) -> int:
        i, out = self.at[start], -1
        while i:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(word number, label) of every base phrase in a text of lower-cased words between blanks."""
    out, at, n = [], 0, 0
    for m in _BASE.finditer(text):
        n += len(text[at : m.start()].split())
        at = m.start()
        out.append((n, _BASE_LABEL[m[1].replace(b" ", b"")]))
    return out


def scan(docs: DataFrame, text: str = "text", detections: bool = True) -> DataFrame:
    """Each row with n_words, n_base, first_word, last_word, base_labels, labels, score, and
    where asked ``detections`` (label, start, end, priority in characters of the text).

    score is the largest weight of what was found, base phrases counting as 0.6, and 0 without
    any.  Null reads as empty: no words, no places, empty labels.  Further columns and repeated
    rows pass through, columns of any name; result columns replace columns of the same name.  Texts
    of any length are taken whole; an empty table gives an empty one.
    """
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] + ["detections"] * detections
    docs = docs.drop(*own)
    callers = docs.columns
    #: Columns travel under names of our own.
    docs, text = docs.toDF(*[f"in_{i}" for i in range(len(callers))]), f"in_{callers.index(text)}"
    kept_columns = docs.columns
    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    lower = {i: i + 32 for i in range(65, 91)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            out = []
            texts = batch.column(batch.schema.names.index(text))
            for k in range(len(texts)):
                t = texts[k].as_py() or ""
                flat = t.encode().translate(_WORD_BYTES)
                places = base_places(flat) if b"license" in flat else []
                found = scanner.detect(t.translate(lower), flat)
                own_labels = {x for _, x in places}
                labels = own_labels | {d.rule.label for d in found}
                score = max([0.6] * bool(places) + [d.rule.weight for d in found], default=0.0)
                row = [len(flat.split()), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(own_labels)), ",".join(sorted(labels)), float(score)]
                out.append(row + [[{"label": d.rule.label, "start": d.start, "end": d.end, "priority": d.rule.priority} for d in found]] * detections)
            cols = list(zip(*out)) if out else [[] for _ in own]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            kinds += [pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32())]))] * detections
            arrays = [batch.column(batch.schema.names.index(c)) for c in kept_columns]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(list(c), kind) for c, kind in zip(cols, kinds)], [*kept_columns, *own])

    schema = f"{base}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    schema += ", detections array<struct<label:string,start:int,end:int,priority:int>>" * detections
    return docs.mapInArrow(work, schema).toDF(*callers, *own)
