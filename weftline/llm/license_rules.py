"""Signature rules of the license scan: families of names and versions, each written out in several forms.

Rules read normalised text: lower-case words, one space before each. A rule has a gate, plain text that every match contains; a
level, lower ones being stronger evidence; a label and a confidence.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    gate: str
    level: int
    form: str
    label: str
    confidence: float
    pattern: str


#: Forms with their levels (the order of suppression) and confidences.
FORMS = {"tag": (0, 1.0), "notice": (1, 0.95), "link": (2, 0.9), "title": (3, 0.8), "name": (4, 0.6)}
LEVELS = len(FORMS)
#: Lead of a licensing notice.
GRANT = r" (?:licen[sc]ed|released|distributed|published|provided|covered|available|redistributed)(?: to you| for use)? under(?: an?| the)?(?: terms(?: and conditions)? of(?: an?| the)?)?"
LICENSE = " licen[sc]e"

#: label, gate of its names, full title, SPDX words, short names (with their gate), words of its addresses (with their gate).
SINGLE = [
    ("mit", "mit licen", " mit licen[sc]e", "mit", None, ("opensource org licenses mit", " opensource org licenses mit")),
    ("mit", "expat licen", " expat licen[sc]e", None, None, None),
    ("x11", "x11 licen", " x11 licen[sc]e", "x11", None, None),
    ("isc", "isc licen", " isc licen[sc]e", "isc", None, ("opensource org licenses isc", " opensource org licenses isc")),
    ("zlib", "zlib", " zlib(?: libpng)? licen[sc]e", "zlib", None, ("licenses zlib", " opensource org licenses zlib")),
    ("unlicense", "unlicense", " the unlicense", "unlicense", ("unlicense", " unlicense"), ("unlicense org", " unlicense org")),
    ("wtfpl", "do what the", " do what the (?:fuck|f) you want to public licen[sc]e", "wtfpl", ("wtfpl", " wtfpl"), ("wtfpl net", " wtfpl net")),
    ("cc0-1.0", "cc0", " cc0(?: 1 0)?(?: universal)?", "cc0 1 0", ("cc0", " cc0"), ("publicdomain zero", " creativecommons org publicdomain zero 1 0")),
    ("ncsa", "ncsa", " (?:university of illinois )?ncsa(?: open source)? licen[sc]e", "ncsa", None, None),
    ("postgresql", "postgresql licen", " postgresql licen[sc]e", "postgresql", None, None),
    ("beerware", "beer", " beer ?ware licen[sc]e", "beerware", ("beerware", " beerware"), None),
    ("json", "json licen", " json licen[sc]e", "json", None, ("json org license", " json org license")),
    ("openssl", "openssl licen", " openssl licen[sc]e", "openssl", None, None),
    ("ms-pl", "microsoft public", " microsoft public licen[sc]e", "ms pl", ("ms pl", " ms pl"), None),
    ("ms-rl", "microsoft reciprocal", " microsoft reciprocal licen[sc]e", "ms rl", ("ms rl", " ms rl"), None),
    ("odbl-1.0", "open database licen", " (?:odc )?open database licen[sc]e(?: v?1 0)?", "odbl 1 0", ("odbl", " odbl"), ("licenses odbl", " opendatacommons org licenses odbl")),
    ("odc-by-1.0", "data commons attribution", " open data commons attribution licen[sc]e(?: v?1 0)?", "odc by 1 0", ("odc by", " odc by"), ("licenses by", " opendatacommons org licenses by")),
    ("pddl-1.0", "public domain dedication", " (?:odc )?public domain dedication(?: and)? licen[sc]e", "pddl 1 0", ("pddl", " pddl"), ("licenses pddl", " opendatacommons org licenses pddl")),
    ("public-domain", "public domain", " (?:dedicated to|released into|placed in|in) the public domain", None, None, None),
    ("proprietary", "proprietary", " proprietary and confidential", None, None, None),
    ("proprietary", "unauthorized", " unauthorized (?:copying|use|reproduction|distribution)(?: of| or)?", None, None, None),
    ("commercial", "commercial licen", " commercial licen[sc]e(?: agreement)?", None, None, None),
    ("eula", "end user licen", " end user licen[sc]e agreement", None, ("eula", " eula"), None),
    ("python-2.0", "python software foundation licen", " python software foundation licen[sc]e(?: version 2)?", "(?:psf|python) 2 0", None, None),
    ("w3c", "w3c software", " w3c software (?:notice and )?licen[sc]e", "w3c", None, None),
    ("unicode", "unicode licen", " unicode licen[sc]e(?: agreement)?", "unicode (?:dfs 2016|3 0)", None, None),
    ("bsd-0-clause", "0 clause", " (?:bsd 0 clause|0 clause bsd|zero clause bsd)", "0bsd", ("0bsd", " 0bsd"), None),
    ("bsd-2-clause", "2 clause", " (?:bsd 2 clause|2 clause bsd)", "bsd 2 clause", None, ("licenses bsd 2", " opensource org licenses bsd 2 clause")),
    ("bsd-2-clause", "simplified bsd", " simplified bsd", None, None, None),
    ("bsd-2-clause", "freebsd licen", " freebsd licen[sc]e", None, None, None),
    ("bsd-3-clause", "3 clause", " (?:bsd 3 clause|3 clause bsd)", "bsd 3 clause", None, ("licenses bsd 3", " opensource org licenses bsd 3 clause")),
    ("bsd-3-clause", "new bsd", " new bsd", None, None, None),
    ("bsd-3-clause", "modified bsd", " modified bsd", None, None, None),
    ("bsd-4-clause", "4 clause", " (?:bsd 4 clause|4 clause bsd)", "bsd 4 clause", None, None),
    ("bsd-4-clause", "original bsd", " original bsd", None, None, None),
    ("bsd", "bsd licen", " bsd licen[sc]e", None, ("bsd style licen", " bsd style licen[sc]e"), None),
    ("sleepycat", "sleepycat licen", " sleepycat licen[sc]e", "sleepycat", None, None),
    ("curl", "curl licen", " curl licen[sc]e", "curl", None, None),
    ("ruby", "ruby licen", " ruby licen[sc]e", "ruby", None, None),
    ("vim", "vim licen", " vim licen[sc]e", "vim", None, None),
    ("hpnd", "historical permission notice", " historical permission notice and disclaimer", "hpnd", None, None),
    ("reserved", "all rights reserved", " all rights reserved", None, None, None),
]

#: label, gate of its names, title, versions, SPDX word, short name (with its gate), words of its addresses (with their gate).
VERSIONED = [
    ("gpl", "general public licen", " (?:gnu )?general public licen[sc]e", ("1.0", "2.0", "3.0"), "gpl", ("gpl", " (?:gnu )?gpl"), ("licenses gpl", " gnu org licenses gpl")),
    ("gpl", "old licenses", " gnu org licenses old licenses gpl", ("1.0", "2.0"), None, None, None),
    ("lgpl", "general public licen", " (?:gnu )?(?:lesser|library) general public licen[sc]e", ("2.0", "2.1", "3.0"), "lgpl", ("lgpl", " (?:gnu )?lgpl"), ("licenses lgpl", " gnu org licenses lgpl")),
    ("agpl", "general public licen", " (?:gnu )?affero general public licen[sc]e", ("1.0", "3.0"), "agpl", ("agpl", " (?:gnu )?agpl"), ("licenses agpl", " gnu org licenses agpl")),
    ("gfdl", "free documentation licen", " (?:gnu )?free documentation licen[sc]e", ("1.1", "1.2", "1.3"), "gfdl", ("gfdl", " gfdl"), ("licenses fdl", " gnu org licenses fdl")),
    ("apache", "apache", " apache(?: software)? licen[sc]e", ("1.0", "1.1", "2.0"), "apache", ("apache", " apache"), ("apache org licenses", " apache org licenses license")),
    ("mpl", "mozilla public licen", " mozilla public licen[sc]e", ("1.0", "1.1", "2.0"), "mpl", ("mpl", " mpl"), ("mozilla org mpl", " mozilla org mpl")),
    ("epl", "eclipse public licen", " eclipse public licen[sc]e", ("1.0", "2.0"), "epl", ("epl", " epl"), ("eclipse org legal", " eclipse org legal epl")),
    ("cddl", "common development and distribution", " common development and distribution licen[sc]e", ("1.0", "1.1"), "cddl", ("cddl", " cddl"), None),
    ("cpl", "common public licen", " common public licen[sc]e", ("1.0",), "cpl", None, None),
    ("eupl", "european union public licen", " european union public licen[sc]e", ("1.0", "1.1", "1.2"), "eupl", ("eupl", " eupl"), None),
    ("artistic", "artistic licen", " artistic licen[sc]e", ("1.0", "2.0"), "artistic", None, ("licenses artistic", " opensource org licenses artistic license")),
    ("afl", "academic free licen", " academic free licen[sc]e", ("1.1", "2.0", "2.1", "3.0"), "afl", None, None),
    ("osl", "open software licen", " open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0"), "osl", None, None),
    ("bsl", "boost software licen", " boost software licen[sc]e", ("1.0",), "bsl", None, ("boost org license", " boost org license")),
    ("ofl", "open font licen", " (?:sil )?open font licen[sc]e", ("1.0", "1.1"), "ofl", ("ofl", " (?:sil )?ofl"), ("sil org ofl", " scripts sil org ofl")),
    ("php", "php licen", " php licen[sc]e", ("3.0", "3.01"), "php", None, None),
    ("lppl", "latex project public licen", " latex project public licen[sc]e", ("1.0", "1.1", "1.2", "1.3"), "lppl", ("lppl", " lppl"), None),
    ("zpl", "zope public licen", " zope public licen[sc]e", ("1.1", "2.0", "2.1"), "zpl", None, None),
    ("cecill", "cecill", " cecill(?: free software)? licen[sc]e(?: agreement)?", ("1.0", "2.0", "2.1"), "cecill", ("cecill", " cecill"), None),
    ("sspl", "server side public licen", " server side public licen[sc]e", ("1.0",), "sspl", ("sspl", " sspl"), None),
    ("busl", "business source licen", " business source licen[sc]e", ("1.1",), "busl", ("busl", " busl"), None),
]
#: Clauses of the Creative Commons licenses: label and words of the long name; each has all VERSIONS.
CLAUSES = {"by": "", "by-sa": " share ?alike", "by-nd": " no ?deriv(?:ative)?s?", "by-nc": " non ?commercial", "by-nc-sa": " non ?commercial share ?alike", "by-nc-nd": " non ?commercial no ?deriv(?:ative)?s?"}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def number(version: str) -> str:
    """Words of a version; a closing zero may be left out."""
    whole, part = version.split(".")
    return rf"(?: version| v| ver)? ?v?{whole}" + (rf"(?: {part})?(?! \d)" if part == "0" else f" {part}")


def forms(label: str, gate: str, title: str, spdx: str | None, short: tuple[str, str] | None, link: tuple[str, str] | None) -> list[Rule]:
    made = [("notice", gate, f"{GRANT}{title}"), ("title", gate, title)]
    if spdx:
        made.append(("tag", "spdx licen", f" spdx licen[sc]e identifier {spdx}"))
    if short:
        made += [("name", short[0], short[1]), ("notice", short[0], f"{GRANT}{short[1]}")]
    if link:
        made.append(("link", link[0], link[1]))
    return [Rule(g, FORMS[form][0], form, label, FORMS[form][1], pattern + "(?![^ ])") for form, g, pattern in made]


def rules() -> list[Rule]:
    """All rules, in order: families as listed, versions before the bare family."""
    out = []
    for label, gate, title, spdx, short, link in SINGLE:
        out += forms(label, gate, f"{title}(?:{LICENSE})?", spdx, short, link)
    for label, gate, title, versions, spdx, short, link in VERSIONED:
        for version in versions:
            v, words = number(version), version.replace(".", " ")
            named = short and (short[0], f"{short[1]}{v}")
            for tail, ending in (("-or-later", "(?: or later| or any later version| or at your option any later version| plus)"), ("-only", " only"), ("", "")) if label in ("gpl", "lgpl", "agpl") else (("", ""),):
                out += forms(f"{label}-{version}{tail}", gate, f"{title}{v}{ending}", spdx and f"{spdx} {words}{ending}", named and (named[0], named[1] + ending), link and (link[0], f"{link[1]}{v}{ending}"))
        out += forms(label, gate, title, None, None if label == "apache" else short, link)  # "apache" alone names no license
    for clause, words in CLAUSES.items():
        plain, brief = clause.replace("-", " "), " cc " + clause.replace("-", " ")
        for version in (*VERSIONS, ""):
            v, label = number(version) if version else "", f"cc-{clause}-{version}" if version else f"cc-{clause}"
            long = f" creative commons attribution{words}{v}(?: international| unported| generic)?(?:{LICENSE})?"
            spdx = f"cc {plain} {version.replace('.', ' ')}" if version else None
            out += forms(label, "creative commons attribution", long, spdx, ("cc by", f"{brief}{v}(?:{LICENSE})?"), ("creativecommons org licenses", f" creativecommons org licenses {plain}{v}"))
    return out
