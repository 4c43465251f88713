"""Signature rules of the license scan, in order of priority.

A rule is (label, regex, keyword, priority). Regexes are matched against the
words of a text, lower-cased and joined by single spaces with one before the
first and after the last; so word borders are spaces. Keywords (several between
bars) are plain strings of which any match of the regex holds one; they gate the
rule.
"""

from __future__ import annotations

import re

#: Label, SPDX identifier's words, and the names that a notice may use (regex, and its keyword).
LICENSES = [
    ("mit", "mit", r"(?:mit|expat|x11) licen[sc]e", "licen"),
    ("mit-0", "mit 0", r"mit no attribution", "mit no attribution"),
    ("apache", "apache(?: licen[sc]e)? 2 0", r"apache (?:software )?licen[sc]e", "apache"),
    ("apache-1.1", "apache 1 1", r"apache (?:software )?licen[sc]e (?:v|version )?1 1", "apache"),
    ("apache-1.0", "apache 1 0", r"apache (?:software )?licen[sc]e (?:v|version )?1 0", "apache"),
    ("gpl", "gpl", r"(?:gnu )?general public licen[sc]e", "general public"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", r"(?:gnu )?general public licen[sc]e (?:v|version )?1(?: 0)?", "general public"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", r"(?:gnu )?general public licen[sc]e (?:v|version )?2(?: 0)?", "general public"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", r"(?:gnu )?general public licen[sc]e (?:v|version )?3(?: 0)?", "general public"),
    ("lgpl", "lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", r"(?:gnu )?library general public licen[sc]e (?:v|version )?2(?: 0)?", "library general"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", r"(?:gnu )?lesser general public licen[sc]e (?:v|version )?2 1", "lesser general"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", r"(?:gnu )?lesser general public licen[sc]e (?:v|version )?3(?: 0)?", "lesser general"),
    ("agpl", "agpl", r"(?:gnu )?affero general public licen[sc]e", "affero"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", r"(?:gnu )?affero general public licen[sc]e (?:v|version )?3(?: 0)?", "affero"),
    ("gfdl", "gfdl 1 [123]", r"(?:gnu )?free documentation licen[sc]e", "free documentation"),
    ("bsd", "bsd", r"(?:revised |new |simplified |modified |original )?bsd(?: style)? licen[sc]e", "bsd"),
    ("bsd-2-clause", "bsd 2 clause", r"(?:2|two) clause bsd|bsd 2 clause", "clause"),
    ("bsd-3-clause", "bsd 3 clause", r"(?:3|three) clause bsd|bsd 3 clause", "clause"),
    ("bsd-4-clause", "bsd 4 clause", r"(?:4|four) clause bsd|bsd 4 clause", "clause"),
    ("0bsd", "0bsd", r"(?:zero clause|free public) bsd|0bsd", "bsd"),
    ("isc", "isc", r"isc licen[sc]e", "isc"),
    ("mpl-1.1", "mpl 1 1", r"mozilla public licen[sc]e (?:v|version )?1 1", "mozilla"),
    ("mpl-2.0", "mpl 2 0", r"mozilla public licen[sc]e(?: (?:v|version )?2 0)?", "mozilla"),
    ("epl-1.0", "epl 1 0", r"eclipse public licen[sc]e (?:v|version )?1 0", "eclipse"),
    ("epl-2.0", "epl 2 0", r"eclipse public licen[sc]e(?: (?:v|version )?2 0)?", "eclipse"),
    ("edl", "bsd 3 clause edl", r"eclipse distribution licen[sc]e", "eclipse"),
    ("cddl", "cddl 1 [01]", r"common development and distribution licen[sc]e", "common development"),
    ("cpl", "cpl 1 0", r"common public licen[sc]e", "common public"),
    ("eupl", "eupl 1 [12]", r"european union public licen[sc]e", "european union"),
    ("cc0", "cc0 1 0", r"cc0|creative commons zero", "cc0|creative commons"),
    ("cc-by", "cc by [1234] [05]", r"(?:cc|creative commons) (?:by|attribution)(?: licen[sc]e)?(?: [1-4] [05])?", "cc by|cc attribution|creative commons"),
    ("cc-by-sa", "cc by sa [1234] [05]", r"(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: [1-4] [05])?", "cc by|cc attribution|creative commons"),
    ("cc-by-nc", "cc by nc [1234] [05]", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)(?: [1-4] [05])?", "cc by|cc attribution|creative commons"),
    ("cc-by-nd", "cc by nd [1234] [05]", r"(?:cc|creative commons) (?:by|attribution) (?:nd|no ?deriv(?:s|atives|ative works))(?: [1-4] [05])?", "cc by|cc attribution|creative commons"),
    ("cc-by-nc-sa", "cc by nc sa [1234] [05]", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: [1-4] [05])?", "cc by|cc attribution|creative commons"),
    ("cc-by-nc-nd", "cc by nc nd [1234] [05]", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:s|atives|ative works))(?: [1-4] [05])?", "cc by|cc attribution|creative commons"),
    ("unlicense", "unlicense", r"unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl|do what the fuck you want to public licen[sc]e", "wtfpl|do what the fuck"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", "zlib"),
    ("libpng", "libpng 2 0", r"libpng licen[sc]e", "libpng"),
    ("bsl-1.0", "bsl 1 0", r"boost software licen[sc]e", "boost software"),
    ("busl-1.1", "busl 1 1", r"business source licen[sc]e", "business source"),
    ("sspl-1.0", "sspl 1 0", r"server side public licen[sc]e", "server side"),
    ("elastic-2.0", "elastic 2 0", r"elastic licen[sc]e", "elastic"),
    ("artistic-1.0", "artistic 1 0", r"artistic licen[sc]e (?:v|version )?1 0", "artistic"),
    ("artistic-2.0", "artistic 2 0", r"artistic licen[sc]e(?: (?:v|version )?2 0)?", "artistic"),
    ("afl-3.0", "afl [123] [01]", r"academic free licen[sc]e", "academic free"),
    ("osl-3.0", "osl [123] [01]", r"open software licen[sc]e", "open software"),
    ("ofl-1.1", "ofl 1 1", r"(?:sil )?open font licen[sc]e", "open font"),
    ("odbl", "odbl 1 0", r"open (?:data commons )?(?:open )?database licen[sc]e", "database"),
    ("odc-by", "odc by 1 0", r"open data commons attribution licen[sc]e", "data commons"),
    ("pddl", "pddl 1 0", r"public domain dedication and licen[sc]e", "public domain"),
    ("psf", "psf 2 0|python 2 0", r"(?:psf|python software foundation) licen[sc]e", "licen"),
    ("ruby", "ruby", r"ruby licen[sc]e", "ruby"),
    ("php", "php 3 0[01]?", r"php licen[sc]e", "php"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl"),
    ("openldap", "oldap 2 8", r"openldap public licen[sc]e", "openldap"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e", "w3c"),
    ("unicode", "unicode dfs 201[56]|unicode 3 0", r"unicode licen[sc]e", "unicode"),
    ("ms-pl", "ms pl", r"microsoft public licen[sc]e", "microsoft public"),
    ("ms-rl", "ms rl", r"microsoft reciprocal licen[sc]e", "microsoft reciprocal"),
    ("ncsa", "ncsa", r"(?:university of illinois|ncsa) (?:ncsa )?open source licen[sc]e", "open source"),
    ("upl", "upl 1 0", r"universal permissive licen[sc]e", "universal permissive"),
    ("vim", "vim", r"vim licen[sc]e", "vim"),
    ("qpl", "qpl 1 0", r"q public licen[sc]e", "q public"),
    ("lppl", "lppl 1 3c?", r"latex project public licen[sc]e", "latex project"),
    ("cecill", "cecill [12] [01]", r"cecill(?: b| c)?", "cecill"),
    ("mulanpsl", "mulanpsl [12] 0", r"mulan (?:permissive software|psl)", "mulan"),
    ("blueoak", "blueoak 1 0 0", r"blue oak model licen[sc]e", "blue oak"),
    ("hippocratic", "hippocratic 2 1", r"hippocratic licen[sc]e", "hippocratic"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)?", "rail"),
    ("parity", "parity [67] 0 0", r"parity public licen[sc]e", "parity public"),
    ("polyform", "polyform(?: noncommercial| small business)? 1 0 0", r"polyform (?:noncommercial|small business|shield|strict|internal use) licen[sc]e", "polyform"),
    ("ipl", "ipl 1 0", r"ibm public licen[sc]e", "ibm public"),
    ("intel-acpi", "intel acpi", r"intel open source licen[sc]e", "intel"),
    ("json", "json", r"json licen[sc]e", "json"),
    ("beerware", "beerware", r"beer ?ware licen[sc]e", "beer"),
]

#: Whole notices that need no name: label, regex, keyword.
NOTICES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission notice"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("bsd-3-clause", r"neither the name of .{1,80} nor the names of its contributors", "neither the name"),
    ("gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public", "free software"),
    ("gpl", r"you should have received a copy of the gnu general public", "should have received"),
    ("lgpl", r"you should have received a copy of the gnu lesser general public", "should have received"),
    ("agpl", r"you should have received a copy of the gnu affero general public", "should have received"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public", "source code form"),
    ("unlicense", r"free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "express or implied"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies", "verbatim or modified"),
    ("public-domain", r"(?:released|dedicated|placed|is) (?:in ?to|to|in) the public domain", "public domain"),
    ("proprietary", r"all rights reserved", "all rights reserved"),
    ("proprietary", r"(?:strictly )?(?:proprietary and confidential|confidential and proprietary)", "proprietary"),
    ("proprietary", r"unauthori[sz]ed copying of this (?:file|text|work|document)", "copying of this"),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright"),
    ("noncommercial", r"for non ?commercial (?:use|purposes) only", "commercial"),
]

#: What may stand before a license's name, and how much that adds to its priority.
FRAMES = [
    ("named", "", 10),
    ("granted", r"(?:licensed|released|distributed|published|available|covered|redistributed|provided|governed) (?:under|by|with) (?:the )?(?:terms of (?:the )?)?(?:[a-z]+ ){0,2}?", 30),
]


def rules() -> list[tuple[str, str, str, int]]:
    """All rules: three for each license (SPDX tag, grant, bare name), then the notices; priority decides overlaps."""
    out = []
    for label, spdx, names, keyword in LICENSES:
        exact = len(label.split("-")) + len(label) / 100
        out.append((label, rf"(?<= )spdx license identifier (?:{spdx})(?= )", "spdx", 50 + int(10 * exact)))
        for _, frame, rank in FRAMES:
            out.append((label, rf"(?<= ){frame}(?:{names})(?= )", keyword, rank + int(5 * exact)))
    out.extend((label, rf"(?<= ){regex}(?= )", keyword, 20) for label, regex, keyword in NOTICES)
    return out


def _needs_license(names: str) -> bool:
    """Whether each alternative has the word license outside of its groups."""
    before = ""
    while before != names:
        before, names = names, re.sub(r"\(\?:[^()]*\)\??", "", names)
    return all("licen[sc]e" in p for p in names.split("|"))


def gate(gap: str) -> str:
    """A regex that any lower-cased text with a match of a rule has; words of a keyword may have any ``gap`` between them."""
    phrases = {"licen[sc]e"}  # tags have it too
    for regex, keyword in [x[2:] for x in LICENSES] + [x[1:] for x in NOTICES]:
        if not _needs_license(regex):
            phrases.update(keyword.split("|"))
    return "|".join(p.replace(" ", gap) for p in sorted(phrases))
