"""License scan with ordered signature rules.

Some hundreds of expressions, in order of priority, say how a license shows
itself: a machine-readable tag, a grant, a sentence of its text, an address, a
bare name.  Sentences are written one by one; the rest is made from a table of
names and versions.  A keyword automaton runs over each text once; only rules
whose keyword stands in it are tried.  Detections are taken by priority, longer
ones first, and one gives way to any taken before that contains it or
overlaps with it.  One pass over the texts, no shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huetide.llm.frames import kept, table
from huetide.llm.keywords import Keywords
from huetide.llm.tokens import ALNUM, Words, chunks

RESULT = (
    "n_words long, places array<struct<label:string,word:long>>, "
    "detections array<struct<label:string,rule:string,rank:int,first_word:long,end_word:long>>"
)
#: Fixed phrases whose every place counts: label, words.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Label, name as words ({v}: a version), versions, keyword of the name, address.  A rule is tried only where its keyword
#: stands, so what the name matches must contain it, however the text is wrapped.
TABLE = [
    ("apache", "apache (?:software )?license", ("1.0", "1.1", "2.0"), "apache", "apache.org/licenses/license-{v}"),
    ("gpl", "gnu general public license", ("1.0", "2.0", "3.0"), "general", "gnu.org/licenses/gpl-{v}"),
    ("lgpl", "gnu (?:lesser|library) general public license", ("2.0", "2.1", "3.0"), "general", "gnu.org/licenses/lgpl-{v}"),
    ("agpl", "gnu affero general public license", ("1.0", "3.0"), "affero", "gnu.org/licenses/agpl-{v}"),
    ("gfdl", "gnu free documentation license", ("1.1", "1.2", "1.3"), "documentation", "gnu.org/licenses/fdl-{v}"),
    ("mpl", "mozilla public license", ("1.0", "1.1", "2.0"), "mozilla", "mozilla.org/mpl/{v}"),
    ("epl", "eclipse public license", ("1.0", "2.0"), "eclipse", "eclipse.org/legal/epl-v{v}"),
    ("cddl", "common development and distribution license", ("1.0", "1.1"), "development", "opensource.org/licenses/cddl-{v}"),
    ("eupl", "european union public licen[cs]e", ("1.0", "1.1", "1.2"), "european", "joinup.ec.europa.eu/eupl/{v}"),
    ("osl", "open software license", ("1.0", "2.0", "2.1", "3.0"), "software", "opensource.org/licenses/osl-{v}"),
    ("afl", "academic free license", ("1.1", "1.2", "2.0", "2.1", "3.0"), "academic", "opensource.org/licenses/afl-{v}"),
    ("artistic", "artistic license", ("1.0", "2.0"), "artistic", "opensource.org/licenses/artistic-{v}"),
    ("zpl", "zope public license", ("1.1", "2.0", "2.1"), "zope", "opensource.org/licenses/zpl-{v}"),
    ("lppl", "latex project public license", ("1.0", "1.1", "1.2", "1.3"), "latex", "latex-project.org/lppl/lppl-{v}"),
    ("boost", "boost software license", ("1.0",), "boost", "boost.org/license_{v}"),
    ("python", "python (?:software foundation )?license", ("2.0",), "python", "python.org/psf/license/{v}"),
    ("ofl", "sil open font license", ("1.0", "1.1"), "font", "scripts.sil.org/ofl/{v}"),
    ("upl", "universal permissive license", ("1.0",), "permissive", "opensource.org/licenses/upl-{v}"),
    ("odbl", "open database license", ("1.0",), "database", "opendatacommons.org/licenses/odbl/{v}"),
    ("odc-by", "open data commons attribution license", ("1.0",), "commons", "opendatacommons.org/licenses/by/{v}"),
    ("ecl", "educational community license", ("1.0", "2.0"), "educational", "opensource.org/licenses/ecl-{v}"),
    ("cpl", "common public license", ("1.0",), "public", "opensource.org/licenses/cpl-{v}"),
    ("mspl", "microsoft (?:public|reciprocal) license", (), "microsoft", "opensource.org/licenses/ms-pl"),
    ("mit", "(?:mit|expat|x11) license", (), "license", "opensource.org/licenses/mit"),
    ("isc", "isc license", (), "isc", "opensource.org/licenses/isc"),
    ("zlib", "zlib(?:/libpng)? license", (), "zlib", "opensource.org/licenses/zlib"),
    ("bsd-2-clause", "(?:simplified|freebsd|2-clause) bsd license|bsd 2-clause(?: license)?", (), "bsd", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "(?:new|revised|modified|3-clause) bsd license|bsd 3-clause(?: license)?", (), "bsd", "opensource.org/licenses/bsd-3-clause"),
    ("bsd", "bsd(?:-style)? license", (), "bsd", "spdx.org/licenses/bsd"),
    ("bsd", "berkeley software distribution(?:-style)? license", (), "berkeley", "spdx.org/licenses/bsd"),
    ("unlicense", "the unlicense", (), "unlicense", "unlicense.org"),
    ("wtfpl", "do what the fuck you want to public license", (), "fuck", "wtfpl.net"),
    ("cc0", "cc0", ("1.0",), "cc0", "creativecommons.org/publicdomain/zero/{v}"),
    ("cc0", "creative commons zero", ("1.0",), "creative", "creativecommons.org/publicdomain/zero/{v}"),
    ("public-domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain", (), "domain", "creativecommons.org/publicdomain/mark"),
    *[
        (f"cc-{kind}", f"{stem}[ -]{'[ -]'.join(f'(?:{p}|{w})' for p, w in parts)}", ("1.0", "2.0", "2.5", "3.0", "4.0"), kw, f"creativecommons.org/licenses/{kind}/{{v}}")
        for kind, parts in (
            ("by", (("by", "attribution"),)),
            ("by-sa", (("by", "attribution"), ("sa", "sharealike"))),
            ("by-nd", (("by", "attribution"), ("nd", "noderivatives"))),
            ("by-nc", (("by", "attribution"), ("nc", "noncommercial"))),
            ("by-nc-sa", (("by", "attribution"), ("nc", "noncommercial"), ("sa", "sharealike"))),
            ("by-nc-nd", (("by", "attribution"), ("nc", "noncommercial"), ("nd", "noderivatives"))),
        )
        for stem, kw in (("cc", "cc"), ("creative commons", "creative"))
    ],
]
#: Sentences of license texts, in order: of equally long ones that overlap the earlier wins.  Label, keyword, expression (a space: any white
#: space and comment marks; every alternative holds the keyword; never \W beside a space, which would try every way to share blanks).
SENTENCES = [
    ("apache-2.0", "grants", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|patent) license"),
    ("apache-2.0", "compliance", r"you may not use this (?:file|work) except in compliance with the license"),
    ("apache-2.0", "basis", r"distributed under the license is distributed on an \"?as is\"? basis"),
    ("apache-2.0", "warranties", r"without warranties or conditions of any kind, either express or implied"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("agpl-3.0", "remotely", r"all users interacting with it remotely through a computer network"),
    ("agpl", "affero", r"under the terms of the gnu affero general public license"),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public license"),
    ("lgpl", "library", r"under the terms of the gnu library general public license"),
    ("lgpl-2.1", "linked", r"a work that uses the library\W+[^.]{0,200}linked with it"),
    ("gpl-3.0", "convey", r"to\W+convey\W+a work means any kind of propagation"),
    ("gpl-3.0", "propagate", r"to\W+propagate\W+a work means to do anything with it"),
    ("gpl-3.0", "installation", r"installation information\W+for a user product"),
    ("gpl-2.0", "franklin", r"51 franklin (?:street|st), fifth floor, boston"),
    ("gpl-2.0", "temple", r"59 temple place,? suite 330, boston"),
    ("gpl-2.0", "version", r"either version 2 of the license, or \(at your option\) any later version"),
    ("gpl-3.0", "version", r"either version 3 of the license, or \(at your option\) any later version"),
    ("gpl-2.0", "version", r"version 2 of the license(?! or)"),
    ("gpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("gpl", "freedom", r"designed to take away your freedom to share and change (?:it|the works)"),
    ("gpl", "copyleft", r"(?:strong|viral) copyleft license"),
    ("gfdl", "invariant", r"with no invariant sections, (?:with )?no front-cover texts"),
    ("gfdl", "cover", r"no front-cover texts,? and (?:with )?no back-cover texts"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-1.1", "contents", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-2.0", "incompatible", r"incompatible with secondary licenses"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-1.0", "eclipse", r"which accompanies this distribution,? and is available at https?://www\.eclipse\.org/legal/epl-v10"),
    ("cddl", "cddl", r"use is subject to license terms[^.]{0,80}cddl"),
    ("cddl", "development", r"subject to the terms of the common development and distribution license"),
    ("mit", "granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", r"to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("mit", "substantial", r"shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit", "dealings", r"out of or in connection with the software or the use or other dealings in the software"),
    ("mit-0", "attribution", r"mit no attribution"),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("0bsd", "bsd", r"zero-clause bsd"),
    ("bsd-4-clause", "display", r"must display the following acknowledge?ment"),
    ("bsd-3-clause", "endorse", r"be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause-views", "interpreted", r"should not be interpreted as representing official policies"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "disclaimed", r"the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", "express", r"this software is provided\W+as-is\W*, without any express or implied warranty"),
    ("boost-1.0", "machine-executable", r"machine-executable object code generated by a source language processor"),
    ("boost-1.0", "boost", r"distributed under the boost software license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", r"dedicate any and all copyright interest in the software to the public domain"),
    ("cc0-1.0", "waived", r"has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc-by", "attribution", r"you must give appropriate credit[^.]{0,60}attribution"),
    ("cc-by", "credit", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made"),
    ("cc-by-sa", "contributions", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "transform", r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("cc", "creative", r"this (?:work|article|book|document) is licensed under a creative commons (?:license|licence)"),
    ("wtfpl", "everyone", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("artistic", "copyright", r"the copyright holder wishes to maintain some semblance of artistic control"),
    ("artistic-1.0-perl", "perl", r"under the same terms as perl itself"),
    ("python-2.0", "psf", r"psf hereby grants licensee a nonexclusive, royalty-free, world-wide license"),
    ("ofl-1.1", "reserved", r"with reserved font name"),
    ("ofl-1.1", "font", r"the font software may be modified, altered, or added to"),
    ("ruby", "ruby", r"under the (?:same )?terms (?:of|as) ruby(?:'s license)?"),
    ("php-3.01", "php", r"this product includes php software"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("json", "evil", r"the software shall be used for good, not evil"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("proprietary", "confidential", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution)[^.]{0,60}(?:is )?(?:strictly )?prohibited"),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("public-domain", "domain", r"this (?:work|file|software) is in the public domain"),
    ("public-domain", "government", r"(?:work|works) of the (?:u\.s\.|united states) government"),
    ("fair-use", "fair", r"(?:considered|constitutes|qualifies as) (?:a )?fair use"),
    ("ogl-uk-3.0", "information", r"contains public sector information licensed under the open government licen[cs]e"),
    ("etalab", "etalab", r"licence ouverte\W+(?:open licence\W+)?etalab"),
    ("gpl", "licence", r"selon les termes de la licence publique g(?:e|é)n(?:e|é)rale gnu"),
    ("gpl", "lizenz", r"unter den bedingungen der gnu general public license[^.]{0,60}lizenz"),
]
#: How sure a detection is by its rank: phrase, bare name, address, sentence, grant, machine-readable tag.
SCORES = {0: 0.5, 1: 0.6, 2: 0.8, 3: 0.85, 4: 0.9, 5: 1.0}

_SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
_NOT_BEFORE, _NOT_AFTER = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"
_FILL = r"[\s*#/\-]+"


class Rule:
    def __init__(self, label: str, name: str, rank: int, keyword: str, pattern: bytes):
        self.label, self.name, self.rank, self.keyword, self.order = label, name, rank, keyword, -1
        self.pattern = re.compile(_NOT_BEFORE + b"(?:" + pattern + b")" + _NOT_AFTER)


def _said(name: str) -> str:
    return re.sub(" (?![^[]*])", lambda _: _FILL, name)


def rules() -> list[Rule]:
    """All rules by priority: tags, grants, sentences, addresses, names; ``order`` says each one's place."""
    out: list[Rule] = []
    for label, name, versions, keyword, address in TABLE:
        for v in (*versions, ""):
            full = f"{label}-{v}" if v else label
            major = v.removesuffix(".0")
            number = re.escape(v) if v == major else rf"{re.escape(major)}(?:\.0)?(?!\.?[0-9])"
            after = rf"(?:,?\s*v(?:ersion)?\.?\s*|\s+|-){number}(?:\s+or\s+(?:any\s+)?later|\+)?" if v else ""
            if not v and versions:
                after = r"(?!,?\s*v(?:ersion)?\.?\s*[0-9])"
            said = f"(?:{_said(name)}){after}"
            grant = rf"(?:licen[cs]ed|released|distributed|available|published|provided)\s+(?:under|with)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{said}"
            made = (
                ("tag", 5, "spdx-license-identifier", rf"spdx-license-identifier:\s*{re.escape(full)}(?:-only|-or-later)?"),
                ("grant", 4, keyword, grant),
                ("address", 2, address.split("/")[0], re.escape(address.format(v=v or "")).rstrip("-/v_")),
                ("name", 1, keyword, said),
            )
            out += [Rule(full, f"{kind}:{full}", rank, word, pattern.encode()) for kind, rank, word, pattern in made if v or kind != "address" or not versions]
    out += [Rule(label, f"sentence:{k}:{label}", 3, keyword, _said(sentence).encode()) for k, (label, keyword, sentence) in enumerate(SENTENCES)]
    seen: set[bytes] = set()
    made = [r for r in out if not (r.pattern.pattern in seen or seen.add(r.pattern.pattern))]
    made.sort(key=lambda r: -r.rank)  # stable: within a rank in the order above
    for k, r in enumerate(made):
        r.order = k
    return made


def phrase_rules() -> list[Rule]:
    return [Rule(label, f"phrase:{label}", 0, max(words.split(), key=len), (_SEP + b"+").join(w.encode() for w in words.split())) for label, words in PHRASES]


class Scanner:
    def __init__(self):
        self.by_word: dict[str, list[Rule]] = {}
        for r in [*phrase_rules(), *rules()]:
            self.by_word.setdefault(r.keyword, []).append(r)
        self.gate = Keywords(self.by_word)

    def scan(self, lowered: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int, Rule]]]:
        """Places of the fixed phrases, and detections that no other suppresses, as bytes."""
        words = sorted({w for _, w in self.gate.hits(lowered)})
        places, found = [], []
        for w in words:
            for r in self.by_word[w]:
                for m in r.pattern.finditer(lowered):
                    if not r.rank:
                        places.append((m.start(), r.label))
                    else:
                        found.append((m.start(), m.end(), r))
        # by priority, then longer before shorter, then the rule's place: what a detection taken before contains or overlaps gives way
        out: list[tuple[int, int, Rule]] = []
        for rank in sorted({r.rank for _, _, r in found}, reverse=True):
            for a, b, r in sorted((x for x in found if x[2].rank == rank), key=lambda x: (x[0] - x[1], x[2].order, x[0])):
                at = bisect.bisect_right(out, a, key=lambda x: x[0])
                if (not at or out[at - 1][1] <= a) and (at == len(out) or out[at][0] >= b):
                    out.insert(at, (a, b, r))
        return sorted(places), out


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """License signatures of every whole text: n_words, places of the fixed phrases, detections.

    Places and spans are word numbers from 0 (words are runs of letters,
    digits and non-ASCII characters).  One row per input row (repeated rows
    stay), with ``keep`` and RESULT.  Null and empty texts have no words and
    nothing is found in them.  Of overlapping detections the higher rank
    stays, then the longer, then the earlier rule.  Other input columns are ignored; a kept one
    that has a name of RESULT gives way to the result.
    """
    carry, schema = kept(docs, keep, RESULT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, scanner = to_arrow_schema(schema), Scanner()
        for whole in batches:
            for batch in chunks(whole, "_text"):
                words = Words(batch.column("_text"), ALNUM, lower=True)
                places, found = [], []
                for i in range(batch.num_rows):
                    lo = words.at[i]
                    own, seen = scanner.scan(words.data[lo : words.at[i + 1]].tobytes())
                    starts = words.starts[words.offsets[i] : words.offsets[i + 1]] if own or seen else None
                    at = lambda p, starts=starts, lo=lo: int(np.searchsorted(starts, p + lo))
                    places.append([{"label": label, "word": at(p)} for p, label in own])
                    found.append([{"label": r.label, "rule": r.name, "rank": r.rank, "first_word": at(a), "end_word": at(b)} for a, b, r in seen])
                made = {"n_words": words.counts, "places": places, "detections": found}
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(v, kinds.field(k).type) for k, v in made.items()], names=[*carry, *made])

    return docs.select(*carry, F.col("text").cast("string").alias("_text")).mapInArrow(work, schema)


def op10_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license signatures; score is that of its surest detection."""
    phrase, other = F.transform("places", lambda p: p["label"]), F.transform("detections", lambda p: p["label"])
    together = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts, score = F.transform("places", lambda p: p["word"]), F.create_map(*[F.lit(v) for kv in SCORES.items() for v in kv])
    best = F.greatest(F.array_max(F.transform("detections", lambda p: p["rank"])), F.when(F.size("places") > 0, 0))
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        together(phrase).alias("base_labels"),
        together(F.concat(phrase, other)).alias("labels"),
        F.coalesce(score[best], F.lit(0.0)).alias("score"),
    )
