"""Signature rules of the license scan, in the order of their priority.

A rule is (priority, label, required words, pattern). Patterns match whole words of a text that was cut
into lower-case words and joined by single blanks, so "Apache-2.0" reads "apache 2 0". The required
words gate the pattern: it is tried only where the text has them all. They are derived from the pattern, and every
match holds them.
"""

from __future__ import annotations

import re
from functools import cache

#: label | SPDX identifier as words | names and notices
_LICENSES = """
apache-2.0|apache 2 0|apache (?:software )?license(?: version)? 2(?: 0)?|apache 2(?: 0)? license
apache-1.1|apache 1 1|apache (?:software )?license(?: version)? 1 1
apache-1.0|apache 1 0|apache (?:software )?license(?: version)? 1 0
mit|mit|(?:the )?mit (?:license|licence)|mit x11 (?:license|licence)|mit style licen[cs]e
mit-0|mit 0|mit no attribution(?: license)?
x11|x11|(?:the )?x11 (?:license|licence)
isc|isc|(?:the )?isc (?:license|licence)|internet systems consortium license
0bsd|0bsd|(?:zero clause|free public) bsd(?: license)?|bsd zero clause license
bsd-2-clause|bsd 2 clause|(?:simplified|freebsd|2 clause|two clause) bsd(?: license)?|bsd 2 clause license
bsd-3-clause|bsd 3 clause|(?:new|modified|revised|3 clause|three clause) bsd(?: license)?|bsd 3 clause license
bsd-4-clause|bsd 4 clause|(?:original|old|4 clause|four clause) bsd(?: license)?|bsd 4 clause license
bsd|bsd|(?:the )?(?:berkeley )?bsd (?:style )?(?:license|licence)
gpl-1.0|gpl 1 0(?: only| or later)?|gpl(?: version)? v?1(?: 0)?
gpl-2.0|gpl 2 0(?: only| or later)?|gpl(?: version)? v?2(?: 0)?(?: only| or later)?
gpl-3.0|gpl 3 0(?: only| or later)?|gpl(?: version)? v?3(?: 0)?(?: only| or later)?
gpl-2.0|gpl 2|gnu general public license(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?
gpl-3.0|gpl 3|gnu general public license(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?
gpl|gpl|gnu gpl|gnu general public licen[cs]e
lgpl-2.0|lgpl 2 0(?: only| or later)?|lgpl(?: version)? v?2(?: 0)?
lgpl-2.1|lgpl 2 1(?: only| or later)?|lgpl(?: version)? v?2 1
lgpl-3.0|lgpl 3 0(?: only| or later)?|lgpl(?: version)? v?3(?: 0)?
lgpl-2.1|lgpl 2 1|gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1
lgpl-3.0|lgpl 3 0|gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3
lgpl|lgpl|gnu (?:lesser|library) general public licen[cs]e|gnu lgpl
agpl-3.0|agpl 3 0(?: only| or later)?|agpl(?: version)? v?3(?: 0)?
agpl-3.0|agpl 3 0|gnu affero general public license(?: version)? 3
agpl|agpl|(?:gnu )?affero general public licen[cs]e
gfdl|gfdl 1 [123](?: only| or later)?|gnu free documentation licen[cs]e(?: version 1 [123])?
mpl-1.0|mpl 1 0|mozilla public license(?: version)? 1 0
mpl-1.1|mpl 1 1|mozilla public license(?: version)? 1 1
mpl-2.0|mpl 2 0|mozilla public license(?: version)? v?2(?: 0)?
mpl|mpl|mozilla public licen[cs]e
epl-1.0|epl 1 0|eclipse public license(?: version)? v?1(?: 0)?
epl-2.0|epl 2 0|eclipse public license(?: version)? v?2(?: 0)?
epl|epl|eclipse public licen[cs]e
edl-1.0|edl 1 0|eclipse distribution license
cddl-1.0|cddl 1 0|cddl(?: version)? 1 0
cddl|cddl|common development and distribution licen[cs]e
cpl-1.0|cpl 1 0|common public license
cpal-1.0|cpal 1 0|common public attribution license
ecl-2.0|ecl 2 0|educational community license
eupl-1.1|eupl 1 1|european union public licen[cs]e(?: v(?:ersion)?)? ?1 1
eupl-1.2|eupl 1 2|european union public licen[cs]e(?: v(?:ersion)?)? ?1 2
eupl|eupl|eupl v? ?1 [012]
artistic-1.0|artistic 1 0|artistic license 1 0
artistic-2.0|artistic 2 0|artistic license 2 0
artistic|artistic|(?:the )?(?:clarified )?artistic licen[cs]e
afl-3.0|afl 3 0|academic free license(?: version)? 3 0
osl-3.0|osl 3 0|open software license(?: version)? 3 0
bsl-1.0|bsl 1 0|boost software licen[cs]e(?: version)?(?: 1 0)?
busl-1.1|busl 1 1|business source license(?: 1 1)?
sspl-1.0|sspl 1 0|server side public license
elastic-2.0|elastic 2 0|elastic license(?: 2 0)?
python-2.0|python 2 0|python software foundation license|psf license
php-3.01|php 3 01|php license(?: version)?(?: 3 01| 3 0)?
ruby|ruby|ruby license
perl|perl 5|same terms as perl(?: itself)?
openssl|openssl|openssl license
zlib|zlib|(?:the )?zlib(?: libpng)? licen[cs]e
libpng|libpng|libpng licen[cs]e
curl|curl|curl licen[cs]e
ijg|ijg|independent jpeg group
icu|icu|icu licen[cs]e
unicode|unicode (?:dfs 2016|3 0)|unicode (?:inc )?licen[cs]e(?: agreement)?
w3c|w3c|w3c software(?: and document)?(?: notice and)? licen[cs]e
ncsa|ncsa|(?:university of illinois )?ncsa(?: open source)? licen[cs]e
upl-1.0|upl 1 0|universal permissive licen[cs]e
unlicense|unlicense|(?:the )?unlicense
wtfpl|wtfpl|wtfpl|do what the fuck you want to public licen[cs]e
beerware|beerware|beer ?ware licen[cs]e
json|json|(?:the )?json licen[cs]e
postgresql|postgresql|(?:the )?postgresql licen[cs]e
vim|vim|vim licen[cs]e
ms-pl|ms pl|microsoft public licen[cs]e
ms-rl|ms rl|microsoft reciprocal licen[cs]e
ofl-1.1|ofl 1 1|sil open font licen[cs]e(?: version)?(?: 1 1)?
ofl|ofl|open font licen[cs]e
lppl|lppl 1 3c|latex project public licen[cs]e
cecill|cecill 2 1|cecill(?: b| c)?(?: free software)? licen[cs]e
qpl-1.0|qpl 1 0|q public licen[cs]e
sleepycat|sleepycat|sleepycat licen[cs]e
blueoak-1.0|blueoak 1 0 0|blue oak model licen[cs]e
mulan-2.0|mulanpsl 2 0|mulan permissive software licen[cs]e
odbl-1.0|odbl 1 0|open (?:data commons )?(?:open )?database licen[cs]e
odc-by-1.0|odc by 1 0|open data commons attribution licen[cs]e
pddl-1.0|pddl 1 0|(?:open data commons )?public domain dedication and licen[cs]e
ogl-3.0|ogl uk 3 0|open government licen[cs]e(?: v(?:ersion)?)?(?: 3 0)?
cc0-1.0|cc0 1 0|cc0(?: 1 0)?(?: universal)?
cc-by-4.0|cc by 4 0|cc by 4 0
cc-by-3.0|cc by 3 0|cc by 3 0
cc-by-2.0|cc by 2 [05]|cc by 2 [05]
cc-by-sa-4.0|cc by sa 4 0|cc by sa 4 0
cc-by-sa-3.0|cc by sa 3 0|cc by sa 3 0
cc-by-sa|cc by sa|cc by sa
cc-by-nc-4.0|cc by nc 4 0|cc by nc 4 0
cc-by-nc-sa-4.0|cc by nc sa 4 0|cc by nc sa(?: 4 0)?
cc-by-nc-nd-4.0|cc by nc nd 4 0|cc by nc nd(?: 4 0)?
cc-by-nc|cc by nc|cc by nc
cc-by-nd|cc by nd 4 0|cc by nd(?: 4 0)?
cc-by-4.0|cc by 4 0 international|creative commons attribution 4 0(?: international)?(?: license)?
cc-by-sa-4.0|cc by sa 4 0 international|creative commons attribution share ?alike 4 0(?: international)?(?: license)?
cc-by-nc-4.0|cc by nc 4 0 international|creative commons attribution non ?commercial 4 0(?: international)?(?: license)?
cc-by|cc by|creative commons attribution(?: license)?
cc|cc|creative commons(?: license)?
"""

#: priority | label | pattern; texts and clues that name no license by themselves
_NOTICES = """
20|mit|permission is hereby granted free of charge to any person obtaining a copy
20|isc|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
20|bsd|redistribution and use in source and binary forms with or without modification are permitted
20|bsd-3-clause|may be used to endorse or promote products derived from this software
20|bsd-4-clause|all advertising materials mentioning features or use of this software must display the following acknowledgement
20|zlib|this software is provided as is without any express or implied warranty in no event will the authors be held liable
20|gpl|you can redistribute it and or modify it under the terms of the gnu general public license
20|lgpl|you can redistribute it and or modify it under the terms of the gnu lesser general public license
20|agpl|you can redistribute it and or modify it under the terms of the gnu affero general public license
20|apache-2.0|you may not use this file except in compliance with the license
20|mpl-2.0|this source code form is subject to the terms of the mozilla public license v 2 0
20|bsl-1.0|distributed under the boost software license version 1 0
20|unlicense|this is free and unencumbered software released into the public domain
20|wtfpl|you just do what the fuck you want to
20|cc0-1.0|dedicated the work to the public domain by waiving all of (?:his or her|their) rights
50|public-domain|(?:released|placed|dedicated|is) (?:in|into|to) the public domain
60|public-domain|public domain
60|proprietary|proprietary (?:and|or) confidential|confidential and proprietary|proprietary licen[cs]e
60|commercial|commercial licen[cs]e(?: agreement)?
60|eula|end user licen[cs]e agreement
70|copyright|all rights reserved
70|copyright|copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])*
80|license-reference|see (?:the )?(?:accompanying )?(?:file )?(?:license|licence|copying)(?: file)? for (?:license |more )?(?:details|information|terms)
80|license-reference|licensed under the same terms as
90|license-clue|(?:license|licence) agreement|terms of (?:the|this) license
"""

_GRANT = "(?:licensed|released|distributed|available|provided|published|covered|governed) (?:under|by|in accordance with)(?: the)?(?: terms of)?(?: the)? "


#: up to the first bar outside of parentheses, and the rest
_FIRST = re.compile(r"((?:[^|(]|\([^)]*\))*)\|(.*)")


def _alternatives(pattern: str) -> list[str]:
    """Split at the bars outside of parentheses."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _strings(pattern: str) -> set[str]:
    """What a pattern matches; repetitions are taken at most once, ranges of digits stay as they are."""
    parts = _alternatives(pattern)
    if len(parts) > 1:
        return set().union(*map(_strings, parts))
    if m := re.search(r"\(\?:([^()]*)\)([?*]?)", pattern):
        options = m[1].split("|") + [""] * bool(m[2])
    elif m := re.search(r"\[([^]-]*)\]", pattern):
        options = list(m[1])
    elif m := re.search(r"([^]])\?", pattern):
        options = [m[1], ""]
    else:
        return {pattern}
    return set().union(*(_strings(pattern[: m.start()] + x + pattern[m.end() :]) for x in options))


@cache
def gates(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of words: each match of the pattern holds all words of one of them, the two longest of a match at most."""
    name = pattern.removeprefix(_GRANT)
    sets = set()
    for x in _strings(name):
        words = {w for w in x.split() if w.isalnum()}
        telling = {w for w in words if not w.isdigit()} or words
        sets.add(frozenset(sorted(telling, key=lambda w: (-len(w), w))[:2]))
    return tuple(sorted(tuple(sorted(x)) for x in sets if not any(y < x for y in sets)))


def rules() -> list[tuple[int, str, list[str], str]]:
    """All rules, by priority: identifiers (10), whole notices (20), grants (30), names (40), clues (50 and up)."""
    patterns: list[tuple[int, str, str]] = []
    for line in _LICENSES.strip().splitlines():
        label, rest = line.split("|", 1)
        spdx, name = _FIRST.match(rest).groups()
        patterns += [(10, label, f"spdx license identifier (?:{spdx})"), (30, label, f"{_GRANT}(?:{name})"), (40, label, name)]
    for line in _NOTICES.strip().splitlines():
        priority, label, pattern = line.split("|", 2)
        patterns.append((int(priority), label, pattern))
    found = [(priority, label, sorted(set.intersection(*map(set, gates(pattern)))), pattern) for priority, label, pattern in patterns]
    return sorted(found, key=lambda r: r[0])
