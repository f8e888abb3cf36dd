"""License scan with ordered signature rules.

Rules are regexes over lower-cased text in which any run of white space counts as one space, each behind a keyword: an Aho-Corasick pass finds the
keywords of a text, and only the rules of those keywords run. Detections are accepted by priority,
then length, then place; one that lies inside an accepted detection is dropped. Base phrases, which
stand as consecutive words, are counted apart from the rules and always keep their labels.

Defined results: null and empty texts have no words and no detections and score 0; repeated rows
each get their own result; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import bisect
import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.store import bound_batches, table
from quire.llm.text import LOWER, LOWER_WORDS, chunks

#: Phrase: label.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_V = r"(?:,? ?(?:version|ver\.?|v\.?)? ?)"
#: Label, keyword that must occur, and the regex of the name as it is written in running text.
FAMILIES = [
    ("mit", "mit", r"(?:the )?mit(?:/x11)?"),
    ("x11", "x11", r"(?:the )?x11"),
    ("isc", "isc", r"(?:the )?isc"),
    ("apache-1.1", "apache", rf"(?:the )?apache(?: software)?(?: license)?{_V}1\.1"),
    ("apache-2.0", "apache", rf"(?:the )?apache(?: software)?(?: license)?{_V}2(?:\.0)?"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified bsd|(?:bsd[- ])?2[- ]clause(?: bsd)?|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new bsd|modified bsd|revised bsd|(?:bsd[- ])?3[- ]clause(?: bsd)?)"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:original bsd|(?:bsd[- ])?4[- ]clause(?: bsd)?)"),
    ("0bsd", "bsd", r"(?:the )?(?:zero[- ]clause bsd|0bsd)"),
    ("gpl-1.0", "gpl", rf"(?:the )?(?:gnu )?gpl{_V}1(?:\.0)?"),
    ("gpl-2.0", "gpl", rf"(?:the )?(?:gnu )?gpl{_V}2(?:\.0)?"),
    ("gpl-3.0", "gpl", rf"(?:the )?(?:gnu )?gpl{_V}3(?:\.0)?"),
    ("gpl-1.0", "general public license", rf"(?:the )?(?:gnu )?general public license{_V}1(?:\.0)?"),
    ("gpl-2.0", "general public license", rf"(?:the )?(?:gnu )?general public license{_V}2(?:\.0)?"),
    ("gpl-3.0", "general public license", rf"(?:the )?(?:gnu )?general public license{_V}3(?:\.0)?"),
    ("lgpl-2.0", "lgpl", rf"(?:the )?(?:gnu )?lgpl{_V}2(?:\.0)?"),
    ("lgpl-2.1", "lgpl", rf"(?:the )?(?:gnu )?lgpl{_V}2\.1"),
    ("lgpl-3.0", "lgpl", rf"(?:the )?(?:gnu )?lgpl{_V}3(?:\.0)?"),
    ("lgpl-2.0", "general public license", rf"(?:the )?(?:gnu )?library general public license{_V}2(?:\.0)?"),
    ("lgpl-2.1", "general public license", rf"(?:the )?(?:gnu )?lesser general public license{_V}2\.1"),
    ("lgpl-3.0", "general public license", rf"(?:the )?(?:gnu )?lesser general public license{_V}3(?:\.0)?"),
    ("agpl-3.0", "agpl", rf"(?:the )?(?:gnu )?agpl{_V}3(?:\.0)?"),
    ("agpl-3.0", "general public license", rf"(?:the )?(?:gnu )?affero general public license{_V}3(?:\.0)?"),
    ("gfdl-1.3", "free documentation license", rf"(?:the )?(?:gnu )?free documentation license{_V}1\.3"),
    ("gfdl-1.2", "free documentation license", rf"(?:the )?(?:gnu )?free documentation license{_V}1\.2"),
    ("mpl-1.1", "mozilla", rf"(?:the )?mozilla public license{_V}1\.1"),
    ("mpl-2.0", "mozilla", rf"(?:the )?mozilla public license{_V}2(?:\.0)?"),
    ("mpl-2.0", "mpl", rf"(?:the )?mpl{_V}2(?:\.0)?"),
    ("epl-1.0", "eclipse", rf"(?:the )?eclipse public license{_V}1(?:\.0)?"),
    ("epl-2.0", "eclipse", rf"(?:the )?eclipse public license{_V}2(?:\.0)?"),
    ("cddl-1.0", "common development", rf"(?:the )?common development and distribution license(?:{_V}1(?:\.0)?)?"),
    ("eupl-1.1", "eupl", rf"(?:the )?eupl{_V}1\.1"),
    ("eupl-1.2", "eupl", rf"(?:the )?eupl{_V}1\.2"),
    ("eupl-1.2", "european union public", rf"(?:the )?european union public licen[cs]e{_V}1\.2"),
    ("artistic-1.0", "artistic", rf"(?:the )?artistic license{_V}1(?:\.0)?"),
    ("artistic-2.0", "artistic", rf"(?:the )?artistic license{_V}2(?:\.0)?"),
    ("bsl-1.0", "boost", rf"(?:the )?boost(?: software)? license(?:{_V}1(?:\.0)?)?"),
    ("busl-1.1", "business source", rf"(?:the )?business source license(?:{_V}1\.1)?"),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)?"),
    ("libpng", "libpng", r"(?:the )?libpng"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", rf"(?:the )?wtfpl(?:{_V}2(?:\.0)?)?"),
    ("psf-2.0", "python software", rf"(?:the )?python software foundation(?: license)?(?:{_V}2(?:\.0)?)?"),
    ("php-3.01", "php", rf"(?:the )?php license{_V}3\.01"),
    ("ruby", "ruby", r"(?:the )?ruby license"),
    ("postgresql", "postgresql", r"(?:the )?postgresql license"),
    ("openssl", "openssl", r"(?:the )?openssl license"),
    ("ms-pl", "microsoft public", r"(?:the )?microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"(?:the )?microsoft reciprocal license"),
    ("ofl-1.1", "open font", rf"(?:the )?(?:sil )?open font license(?:{_V}1\.1)?"),
    ("odbl-1.0", "open database", rf"(?:the )?open database license(?:{_V}1(?:\.0)?)?"),
    ("odc-by-1.0", "open data commons", r"(?:the )?open data commons attribution(?: license)?"),
    ("pddl-1.0", "public domain dedication", r"(?:the )?(?:odc |open data commons )?public domain dedication(?: and license)?"),
    ("cc0-1.0", "cc0", rf"(?:the )?cc0(?:{_V}1\.0)?"),
    ("cecill-2.1", "cecill", rf"(?:the )?cecill(?: license)?{_V}2\.1"),
    ("afl-3.0", "academic free", rf"(?:the )?academic free license{_V}3(?:\.0)?"),
    ("osl-3.0", "open software license", rf"(?:the )?open software license{_V}3(?:\.0)?"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois/)?ncsa(?: open source)?"),
    ("upl-1.0", "universal permissive", r"(?:the )?universal permissive license"),
    ("mulan-psl-2.0", "mulan", rf"(?:the )?mulan (?:psl|permissive software license){_V}2(?:\.0)?"),
    ("openrail-m", "openrail", r"(?:the )?(?:creativeml )?openrail(?:[-+]+m)?"),
    ("proprietary", "proprietary", r"(?:a |the )?proprietary"),
    ("apsl-2.0", "apple public", rf"(?:the )?apple public source license(?:{_V}2(?:\.0)?)?"),
    ("blueoak-1.0.0", "blue oak", rf"(?:the )?blue oak model license(?:{_V}1(?:\.0){{0,2}})?"),
    ("cpal-1.0", "common public attribution", rf"(?:the )?common public attribution license(?:{_V}1(?:\.0)?)?"),
    ("cpl-1.0", "common public license", rf"(?:the )?common public license(?:{_V}1(?:\.0)?)?"),
    ("ecl-2.0", "educational community", rf"(?:the )?educational community license(?:{_V}2(?:\.0)?)?"),
    ("efl-2.0", "eiffel forum", rf"(?:the )?eiffel forum license(?:{_V}2)?"),
    ("elastic-2.0", "elastic license", rf"(?:the )?elastic license(?:{_V}2(?:\.0)?)?"),
    ("etalab-2.0", "etalab", r"(?:the )?etalab open(?: license)?(?: 2\.0)?"),
    ("ftl", "freetype", r"(?:the )?freetype(?: project)?"),
    ("hpnd", "historical permission", r"(?:the )?historical permission notice and disclaimer"),
    ("ijg", "independent jpeg", r"(?:the )?independent jpeg group"),
    ("imagemagick", "imagemagick", r"(?:the )?imagemagick"),
    ("ipl-1.0", "ibm public", rf"(?:the )?ibm public license(?:{_V}1(?:\.0)?)?"),
    ("json", "json", r"(?:the )?json"),
    ("lppl-1.3c", "latex project", rf"(?:the )?latex project public license(?:{_V}1\.3c?)?"),
    ("lppl-1.3c", "lppl", rf"(?:the )?lppl(?:{_V}1\.3c?)?"),
    ("miros", "miros", r"(?:the )?miros"),
    ("ms-lpl", "microsoft limited", r"(?:the )?microsoft limited public license"),
    ("nasa-1.3", "nasa", rf"(?:the )?nasa open source agreement(?:{_V}1\.3)?"),
    ("npl-1.1", "netscape", rf"(?:the )?netscape public license(?:{_V}1\.[01])?"),
    ("oclc-2.0", "oclc", rf"(?:the )?oclc research public license(?:{_V}2(?:\.0)?)?"),
    ("oldap-2.8", "openldap", rf"(?:the )?openldap public license(?:{_V}2\.8)?"),
    ("opl-1.0", "open publication", rf"(?:the )?open publication license(?:{_V}1(?:\.0)?)?"),
    ("php-3.0", "php", rf"(?:the )?php license{_V}3\.0(?!1)"),
    ("polyform-nc-1.0.0", "polyform", r"(?:the )?polyform noncommercial(?: license)?(?: 1\.0\.0)?"),
    ("qpl-1.0", "q public", rf"(?:the )?q public license(?:{_V}1(?:\.0)?)?"),
    ("rpl-1.5", "reciprocal public", rf"(?:the )?reciprocal public license(?:{_V}1\.5)?"),
    ("sgi-b-2.0", "sgi free", rf"(?:the )?sgi free software license b(?:{_V}2(?:\.0)?)?"),
    ("sissl", "sun industry", r"(?:the )?sun industry standards source license"),
    ("sleepycat", "sleepycat", r"(?:the )?sleepycat"),
    ("spl-1.0", "sun public", rf"(?:the )?sun public license(?:{_V}1(?:\.0)?)?"),
    ("sspl-1.0", "server side public", rf"(?:the )?server side public license(?:{_V}1)?"),
    ("sspl-1.0", "sspl", rf"(?:the )?sspl(?:{_V}1)?"),
    ("tcl", "tcl", r"(?:the )?tcl/tk"),
    ("vim", "vim", r"(?:the )?vim"),
    ("vsl-1.0", "vovida", rf"(?:the )?vovida software license(?:{_V}1(?:\.0)?)?"),
    ("w3c", "w3c", r"(?:the )?w3c(?: software(?: and document)?)?"),
    ("watcom-1.0", "watcom", rf"(?:the )?sybase open watcom public license(?:{_V}1(?:\.0)?)?"),
    ("zend-2.0", "zend", rf"(?:the )?zend(?: engine)? license{_V}2(?:\.0)?"),
    ("zpl-2.1", "zope", rf"(?:the )?zope public license{_V}2\.1"),
    ("zpl-2.0", "zope", rf"(?:the )?zope public license{_V}2\.0"),
    ("commons-clause", "commons clause", r"(?:the )?commons clause"),
    ("ogl-3.0", "open government", rf"(?:the )?open government licen[cs]e(?:{_V}3(?:\.0)?)?"),
    ("cdla-permissive-2.0", "community data", r"(?:the )?community data license agreement"),
    ("gust-font", "gust font", r"(?:the )?gust font"),
    ("bitstream-vera", "bitstream vera", r"(?:the )?bitstream vera"),
]
#: The Creative Commons terms; each comes in the versions 1.0 to 4.0.
CC_TERMS = {"by": "attribution", "by-sa": "attribution-sharealike", "by-nc": "attribution-noncommercial", "by-nd": "attribution-noderiv(?:ative)?s", "by-nc-sa": "attribution-noncommercial-sharealike", "by-nc-nd": "attribution-noncommercial-noderiv(?:ative)?s"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Label, keyword, and a sentence of the license text itself.
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use", r"redistributions? and use in source and binary forms, with or without modification"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,80}? may be used to endorse or promote products"),
    ("apache-2.0", "apache.org/licenses", r"apache\.org/licenses/license-2\.0"),
    ("gpl-2.0-or-later", "at your option", r"either version 2 of the license,? or \(?at your option\)? any later version"),
    ("gpl-3.0-or-later", "at your option", r"either version 3 of the license,? or \(?at your option\)? any later version"),
    ("gpl", "free software foundation", r"as published by the free software foundation"),
    ("gpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?(?:a|l)?gpl"),
    ("mpl-2.0", "mozilla.org/mpl", r"subject to the terms of the mozilla public license|mozilla\.org/mpl/2\.0"),
    ("unlicense", "released into the public domain", r"free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:is|are|placed|released|dedicated) (?:in|into|to) the public domain"),
    ("cc0-1.0", "creativecommons.org/publicdomain", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to"),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("mit", "the software is provided", r"the software is provided [\"']?as is[\"']?, without warranty of any kind"),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("bsd", "in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "of source code must retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "limitations under the license", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "distributed on an", r"distributed on an [\"']?as is[\"']? basis, without warranties or conditions of any kind"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("gpl", "received a copy of the gnu", r"you should have received a copy of the gnu general public license"),
    ("lgpl", "received a copy of the gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl-3.0", "received a copy of the gnu", r"you should have received a copy of the gnu affero general public license"),
    ("gpl", "implied warranty of", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "can redistribute it", r"free software[;:,]? you can redistribute it and/?(?:or)? modify it"),
    ("gfdl", "copy, distribute and", r"permission is granted to copy, distribute and/?(?:or)? modify this document"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("epl-1.0", "eclipse.org/legal/epl-v10", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse.org/legal/epl-2.0", r"eclipse\.org/legal/epl-2\.0"),
    ("bsl-1.0", "boost.org", r"boost\.org/license_1_0"),
    ("isc", "opensource.org/licenses", r"opensource\.org/licen[cs]es/isc"),
    ("mit", "opensource.org/licenses", r"opensource\.org/licen[cs]es/mit"),
    ("bsd-3-clause", "opensource.org/licenses", r"opensource\.org/licen[cs]es/bsd-3-clause"),
    ("bsd-2-clause", "opensource.org/licenses", r"opensource\.org/licen[cs]es/bsd-2-clause"),
    ("ofl-1.1", "scripts.sil.org", r"scripts\.sil\.org/ofl"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("json", "for good, not evil", r"the software shall be used for good, not evil"),
    ("beerware", "beer in return", r"you can buy me a beer in return"),
    ("curl", "copyright holder shall not be used in advertising", r"the name of a copyright holder shall not be used in advertising"),
    ("ncsa", "contributors may be used", r"nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("proprietary", "confidential and proprietary", r"(?:strictly )?confidential and proprietary"),
    ("proprietary", "unauthorized copying", r"unauthori[sz]ed (?:copying|reproduction|distribution|use)[^.]{0,60}? is (?:strictly )?prohibited"),
    ("proprietary", "end user license", r"end[- ]user licen[cs]e agreement"),
    ("non-commercial", "non commercial", r"for non[- ]commercial (?:use|purposes) only"),
    ("non-commercial", "noncommercial", r"for noncommercial (?:use|purposes) only"),
    ("no-derivatives", "no derivative", r"no derivative works(?: are)? (?:allowed|permitted)"),
]
#: Wordings around a name: what they are called, priority (lower first), confidence, and the regex.
FORMS = [
    ("grant", 2, 0.9, r"(?:dual[- ])?(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered) (?:here )?(?:under|by|with)(?: the)?(?: terms(?: and conditions)?| conditions)?(?: of)? {name}(?: licen[cs]e)?"),
    ("field", 3, 0.85, r"licen[cs]e ?[:=] ?[\"']?{name}\b"),
    ("subject", 4, 0.8, r"(?:subject to|governed by|see|accept|under) {name} licen[cs]e"),
    ("name", 5, 0.6, r"{name} licen[cs]e(?:{v}\d(?:\.\d+)*)?"),
]


#: What an identifier may end in, and that nothing of a longer one follows.
LATER = r"(?:-only|-or-later|\+)?(?![\w-]|\.\d)"


def _number(version: str) -> str:
    """``2.0`` as it is written: a last zero may be left out."""
    return re.escape(version.removesuffix(".0")) + (r"(?:\.0)?" if version.endswith(".0") else "")


class Rule(NamedTuple):
    name: str
    label: str
    keyword: bytes
    pattern: bytes
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules in order: tags, license sentences, then the forms of every name."""
    ids = dict.fromkeys(f[0] for f in FAMILIES)
    out = [Rule(f"tag:{x}", x, b"spdx-license-identifier", rf"spdx-license-identifier: ?\(?{re.escape(x)}{LATER}".encode(), 0, 1.0) for x in ids]
    out += [Rule(f"id:{x}", x, x.encode(), f"{re.escape(x)}{LATER}".encode(), 2, 0.9) for x in ids if re.search(r"[a-z].*-\d", x)]
    out += [Rule(f"short:{x}", x, x.partition("-")[0].encode(), rf"{x.partition('-')[0]}[ -]?v?\.? ?{_number(x.partition('-')[2])}{LATER}".encode(), 3, 0.8) for x in ids if re.fullmatch(r"[al]?gpl-\d\.\d", x)]
    out += [Rule(f"text:{label}:{i}", label, key.encode(), pattern.encode(), 1, 0.95) for i, (label, key, pattern) in enumerate(SENTENCES)]
    names = list(FAMILIES)
    for code, words in CC_TERMS.items():
        for v in CC_VERSIONS:
            label, at = f"cc-{code}-{v}", re.escape(v)
            out.append(Rule(f"url:{label}", label, b"creativecommons.org/licenses", rf"creativecommons\.org/licenses/{code}/{at}".encode(), 1, 0.95))
            names.append((label, "creative commons", rf"(?:the )?creative commons {words} {at}(?: international| unported| generic)?"))
            names.append((label, "cc", rf"(?:the )?cc[- ]{code}[- ]{at}"))
    for label, key, name in names:
        for form, priority, confidence, pattern in FORMS:
            out.append(Rule(f"{form}:{label}", label, key.encode(), pattern.replace("{name}", f"(?:{name})").replace("{v}", _V).encode(), priority, confidence))
        if label.startswith("cc-") or "licen" in name or "clause" in name:  # names that need no word behind them
            out.append(Rule(f"code:{label}", label, key.encode(), name.encode(), 6, 0.6))
    return out


def squeezed(low: bytes) -> tuple[bytes, np.ndarray]:
    """``low`` with one space for each run of white space, and where each of its bytes was."""
    raw = np.frombuffer(low, np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    places = np.flatnonzero(~(white & np.concatenate(([False], white[:-1]))))
    return np.where(white, np.uint8(32), raw)[places].tobytes(), places


class Scanner:
    """Keyword automaton and compiled rules; one per Python worker."""

    def __init__(self, phrases: tuple[tuple[str, str], ...]):
        import ahocorasick

        self.rules = [(r, re.compile(rb"(?<![a-z0-9])" + r.pattern)) for r in rules()]
        gates: dict[str, list[int]] = {}
        for i, (r, _) in enumerate(self.rules):
            gates.setdefault(b" ".join(r.keyword.translate(LOWER_WORDS).split()).decode(), []).append(i)
        self.keywords = ahocorasick.Automaton()
        for k, ids in gates.items():
            self.keywords.add_word(k, (k, ids))
        self.keywords.make_automaton()
        self.phrases = [(p.encode(), label) for p, label in phrases]

    def detections(self, low: bytes, words: bytes) -> list[tuple[Rule, int, int]]:
        """Accepted detections of a lower-cased text, also given as space-joined words, with their byte spans in page order."""
        gate = {k: ids for _, (k, ids) in self.keywords.iter(words.decode("latin-1"))}
        if not gate:
            return []
        flat, places = squeezed(low)
        hits = [(r, int(places[m.start()]), int(places[m.end() - 1]) + 1) for i in sorted(i for ids in gate.values() for i in ids) for r, p in [self.rules[i]] for m in p.finditer(flat)]
        hits.sort(key=lambda h: (h[0].priority, h[1] - h[2], h[1], h[0].name))
        taken: list[tuple[Rule, int, int]] = []
        starts: list[int] = []  # of the spans taken that lie in no other one: both ends ascend
        stops: list[int] = []
        for r, a, b in hits:
            at = bisect.bisect_right(starts, a)
            if at and stops[at - 1] >= b:
                continue
            taken.append((r, a, b))
            first, last = bisect.bisect_left(starts, a), bisect.bisect_right(stops, b)
            starts[first : max(first, last)], stops[first : max(first, last)] = [a], [b]
        return sorted(taken, key=lambda h: (h[1], h[2]))

    def base(self, words: bytes) -> list[tuple[str, int]]:
        """Labels and word numbers of the base phrases in space-joined words with a space at both ends."""
        out = []
        for phrase, label in self.phrases:
            number, seen, at = 0, 0, words.find(b" " + phrase + b" ")
            while at >= 0:
                number, seen = number + words.count(b" ", seen, at), at
                out.append((label, number))
                at = words.find(b" " + phrase + b" ", at + 1)
        return sorted(out, key=lambda x: (x[1], x[0]))


@functools.lru_cache(4)
def scanner(phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(phrases)


_KIND = pa.struct([
    ("n_words", pa.int64()),
    ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("detections", pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("confidence", pa.float64())]))),
])


def scan(text: Column, phrases: dict[str, str] = BASE_PHRASES) -> Column:
    """``struct<n_words, base, detections>`` of each text; spans count UTF-8 bytes."""
    fixed = tuple(phrases.items())

    @F.arrow_udf("n_words long, base array<struct<label:string,word:long>>, detections array<struct<rule:string,label:string,start:long,stop:long,confidence:double>>")
    def scanned(batch: pa.Array) -> pa.Array:
        s, out = scanner(fixed), []
        for run in chunks(batch):
            for t in run:
                raw = t.encode()
                words = raw.translate(LOWER_WORDS).split()
                joined = b" " + b" ".join(words) + b" "
                out.append({
                    "n_words": len(words),
                    "base": [{"label": x, "word": w} for x, w in s.base(joined)],
                    "detections": [{"rule": r.name, "label": r.label, "start": a, "stop": b, "confidence": r.confidence} for r, a, b in s.detections(raw.translate(LOWER), joined)],
                })
        return pa.array(out, _KIND)

    return scanned(text)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts, first and last base places, labels and confidence per row."""
    bound_batches(docs.sparkSession)
    found = docs.select(F.col(key), scan(F.col(text)).alias("s")).select(key, "s.n_words", "s.base", "s.detections")
    base_labels, words = F.col("base.label"), F.col("base.word")
    confidence = F.coalesce(F.array_max("detections.confidence"), F.lit(0.0))
    return found.select(
        key,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("detections.label"))), ",").alias("labels"),
        F.greatest(confidence, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
