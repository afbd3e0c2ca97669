"""Ordered signature rules of the license scan, over words joined by one space.

A rule is (label, priority, confidence, keyword, pattern). The keyword is plain text that every match
contains, so a text without it never meets the pattern. Most rules come from a name in a frame of words;
the rest are sentences of license texts. All are written by hand from the public license texts and names.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


_LICENSE = "licen[cs]es?"

#: (label, keyword, name as a pattern, SPDX identifier as words or nothing)
NAMES = [
    ("mit", "mit", f"mit {_LICENSE}", "mit"),
    ("mit", "expat", f"expat {_LICENSE}", ""),
    ("mit-0", "mit", f"mit no attribution(?: {_LICENSE})?", "mit 0"),
    ("x11", "x11", f"x11 {_LICENSE}", "x11"),
    ("apache-2", "apache", f"apache(?: software)? {_LICENSE}(?: version)? 2(?: 0)?", "apache 2 0"),
    ("apache-2", "apache", "apache 2(?: 0)?", ""),
    ("apache-2", "asl", "asl 2(?: 0)?", ""),
    ("apache-1.1", "apache", f"apache(?: software)? {_LICENSE}(?: version)? 1 1", "apache 1 1"),
    ("apache-1", "apache", f"apache(?: software)? {_LICENSE}(?: version)? 1 0", "apache 1 0"),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e", ""),
    ("gpl-2", "general public", "(?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?", "gpl 2 0(?: only)?"),
    ("gpl-2+", "general public", "(?:gnu )?general public licen[cs]e(?: gpl)?(?: version)? 2(?: 0)? or(?: at your option)? (?:any )?later(?: version)?", "gpl 2 0 or later"),
    ("gpl-3", "general public", "(?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?", "gpl 3 0(?: only)?"),
    ("gpl-3+", "general public", "(?:gnu )?general public licen[cs]e(?: gpl)?(?: version)? 3(?: 0)? or(?: at your option)? (?:any )?later(?: version)?", "gpl 3 0 or later"),
    ("gpl-2", "gpl", "(?:gnu )?gpl ?v?(?:ersion )?2(?: 0)?", ""),
    ("gpl-2", "gplv2", "(?:gnu )?gplv2", ""),
    ("gpl-3", "gpl", "(?:gnu )?gpl ?v?(?:ersion )?3(?: 0)?", ""),
    ("gpl-3", "gplv3", "(?:gnu )?gplv3", ""),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version)? 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lesser general", "(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version)? 3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public licen[cs]e", ""),
    ("lgpl-2", "library general", "(?:gnu )?library general public licen[cs]e(?: version 2)?", "lgpl 2 0(?: only| or later)?"),
    ("agpl-3", "affero", "(?:gnu )?affero general public licen[cs]e(?: agpl)?(?: version)? 3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", ""),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("bsd-2", "bsd", f"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) {_LICENSE}", "bsd 2 clause"),
    ("bsd-3", "bsd", f"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) {_LICENSE}", "bsd 3 clause"),
    ("bsd-4", "bsd", f"(?:original bsd|bsd 4 clause|4 clause bsd) {_LICENSE}", "bsd 4 clause"),
    ("0bsd", "bsd", f"(?:zero clause bsd|bsd zero clause|0bsd) {_LICENSE}", "0bsd"),
    ("bsd", "bsd", f"bsd(?: style)? {_LICENSE}", ""),
    ("isc", "isc", f"isc {_LICENSE}", "isc"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_LICENSE}", "zlib"),
    ("libpng", "libpng", f"libpng {_LICENSE}", "libpng"),
    ("boost-1", "boost", f"boost software {_LICENSE}(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("mpl-2", "mozilla", f"mozilla public {_LICENSE}(?: version)? 2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla", f"mozilla public {_LICENSE}(?: version)? 1 1", "mpl 1 1"),
    ("mpl", "mozilla", f"mozilla public {_LICENSE}", ""),
    ("epl-2", "eclipse", f"eclipse public {_LICENSE}(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("epl-1", "eclipse", f"eclipse public {_LICENSE}(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("cddl-1", "common development", f"common development and distribution {_LICENSE}(?: version)?(?: 1 [01])?", "cddl 1 [01]"),
    ("eupl-1.2", "european union", f"european union public {_LICENSE}(?: version| v)?(?: 1 [12])?", "eupl 1 [12]"),
    ("ms-pl", "microsoft public", f"microsoft public {_LICENSE}", "ms pl"),
    ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {_LICENSE}", "ms rl"),
    ("artistic-2", "artistic", f"artistic {_LICENSE}(?: version)? 2(?: 0)?", "artistic 2 0"),
    ("artistic-1", "artistic", f"artistic {_LICENSE}(?: version)? 1(?: 0)?", "artistic 1 0"),
    ("wtfpl", "wtfpl", f"wtfpl(?: {_LICENSE})?", "wtfpl"),
    ("unlicense", "unlicense", "(?:the )?unlicense(?: license)?", "unlicense"),
    ("postgresql", "postgresql", f"postgresql {_LICENSE}", "postgresql"),
    ("python-2", "python", f"python software foundation {_LICENSE}(?: version 2)?", "(?:psf|python) 2 0"),
    ("python-2", "psf", f"psf {_LICENSE}(?: version 2)?", ""),
    ("ruby", "ruby", f"ruby {_LICENSE}", "ruby"),
    ("php-3", "php", f"php {_LICENSE}(?: version)?(?: 3 0(?: 1)?)?", "php 3 0(?: 1)?"),
    ("ofl-1.1", "open font", f"(?:sil )?open font {_LICENSE}(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("afl-3", "academic free", f"academic free {_LICENSE}(?: version| v)?(?: 3(?: 0)?)?", "afl 3 0"),
    ("osl-3", "open software", f"open software {_LICENSE}(?: version| v)?(?: 3(?: 0)?)?", "osl 3 0"),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_LICENSE}", "ncsa"),
    ("odbl", "open database", f"open database {_LICENSE}(?: odbl)?", "odbl 1 0"),
    ("odc-by", "open data commons", f"open data commons attribution {_LICENSE}", "odc by 1 0"),
    ("pddl", "public domain dedication", "public domain dedication and licen[cs]e", "pddl 1 0"),
    ("cecill-2.1", "cecill", f"cecill(?: {_LICENSE})?(?: version| v)?(?: 2 1)?", "cecill 2 1"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?(?! nc| nd| sa| [1-4] [05] nc)", "cc by [1-4] [05]"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by nc", "cc by nc(?! nd| sa)(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] [05])?(?: international| unported)? licen[cs]e", ""),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", ""),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?! share| no)(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", ""),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", ""),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", ""),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", ""),
]

#: (priority, confidence, words before the name, words after it)
FRAMES = [
    (3, 0.98, "(?:licen[cs]ed|released|distributed|published|offered|available|provided|shared|covered|dual licensed) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", ""),
    (2, 0.9, "(?:subject to|governed by|in accordance with|according to|pursuant to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", ""),
    (2, 0.85, "(?:licen[cs]e|lizenz|licencia|lizenziert unter|bajo la licencia|sous licence) (?:is )?(?:the )?", ""),
    (1, 0.7, "", ""),
]

#: (label, priority, confidence, keyword, pattern): sentences of license texts.
SENTENCES = [
    ("mit", 3, 0.97, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 3, 0.95, "permission to use copy", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 2, 0.9, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", 3, 0.95, "neither the name", "neither the name of .{1,80}? nor the names of its contributors"),
    ("bsd-4", 3, 0.95, "all advertising materials", "all advertising materials mentioning features or use of this software"),
    ("apache-2", 3, 0.97, "you may not use this file", "you may not use this file except in compliance with the license"),
    ("gpl", 3, 0.9, "free software you can", "this program is free software you can redistribute it and or modify it"),
    ("gpl", 2, 0.8, "without even the implied", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2", 3, 0.97, "this source code form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", 3, 0.95, "provided as is", "this software is provided as is without any express or implied warranty in no event"),
    ("unlicense", 3, 0.97, "released into the public domain", "free and unencumbered software released into the public domain"),
    ("boost-1", 3, 0.97, "boost software license", "permission is hereby granted .{0,200}? boost software license"),
    ("wtfpl", 3, 0.95, "do what the fuck", "do what the fuck you want to public license"),
    ("cc0", 2, 0.9, "waived all copyright", "(?:has|have) waived all copyright and related or neighboring rights"),
    ("public-domain", 1, 0.7, "public domain", "(?:is|are|placed|released|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", 1, 0.6, "all rights reserved", "(?:copyright .{0,60}? )?all rights reserved"),
    ("proprietary", 2, 0.8, "proprietary and confidential", "proprietary and confidential"),
]

#: Phrases and labels of the base count.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def rules() -> list[Rule]:
    """All rules in order; the order settles what priority and interval leave open."""
    out = []
    for label, keyword, name, spdx in NAMES:
        out += [Rule(label, p, c, keyword, f"{before}{name}{after}") for p, c, before, after in FRAMES]
        if spdx:
            out.append(Rule(label, 4, 1.0, "spdx license identifier", f"spdx license identifier {spdx}"))
    return out + [Rule(*x) for x in SENTENCES]
