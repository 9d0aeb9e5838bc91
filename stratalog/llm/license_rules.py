"""Signature rules for license texts, in order of priority.

Patterns are written for normalised text: lower-case words with one space between them ("apache license version
2 0", "spdx license identifier gpl 2 0 or later"). A rule's gate is a piece of text without which its pattern cannot
match; only rules whose gate occurs are tried. Gates are read off the patterns, and alternatives of a pattern are rules
of their own, so that each has a gate that it needs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases whose places are counted apart; their detections are never suppressed.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: label | how the license is named
NAMES = """
apache-1.0 | apache (?:software )?licen[cs]e (?:version |v )?1 0
apache-1.1 | apache (?:software )?licen[cs]e (?:version |v )?1 1
apache-2.0 | apache (?:software )?licen[cs]e (?:version |v ?)?2(?: 0)?|apache 2 0(?: licen[cs]e)?|asl 2 0
mit | mit licen[cs]e|mit expat licen[cs]e|expat licen[cs]e|mit x11 licen[cs]e
mit-0 | mit no attribution(?: licen[cs]e)?|mit 0 licen[cs]e
x11 | x11 licen[cs]e
isc | isc licen[cs]e|internet systems consortium licen[cs]e
bsd-0-clause | (?:0|zero) clause bsd(?: licen[cs]e)?|bsd 0 clause|0bsd
bsd-1-clause | (?:1|one) clause bsd(?: licen[cs]e)?|bsd 1 clause
bsd-2-clause | (?:2|two) clause bsd(?: licen[cs]e)?|bsd 2 clause|simplified bsd licen[cs]e|freebsd licen[cs]e
bsd-3-clause | (?:3|three) clause bsd(?: licen[cs]e)?|bsd 3 clause|(?:new|modified|revised) bsd licen[cs]e
bsd-4-clause | (?:4|four) clause bsd(?: licen[cs]e)?|bsd 4 clause|original bsd licen[cs]e
bsd-patent | bsd (?:plus |2 clause plus )?patent(?: licen[cs]e)?
bsd | bsd (?:style )?licen[cs]e
gpl-1.0 | gpl ?(?:version |v ?)?1 0|gplv1
gpl-2.0-only | gpl ?(?:version |v ?)?2(?: 0)? only|gplv2 only
gpl-2.0-or-later | gpl ?(?:version |v ?)?2(?: 0)? or (?:any )?later|gplv2 or (?:any )?later
gpl-2.0 | gpl ?(?:version |v ?)?2(?: 0)?|gplv2
gpl-3.0-only | gpl ?(?:version |v ?)?3(?: 0)? only|gplv3 only
gpl-3.0-or-later | gpl ?(?:version |v ?)?3(?: 0)? or (?:any )?later|gplv3 or (?:any )?later
gpl-3.0 | gpl ?(?:version |v ?)?3(?: 0)?|gplv3
gpl-2.0 | gnu general public licen[cs]e (?:version |v ?)2(?: 0)?
gpl-3.0 | gnu general public licen[cs]e (?:version |v ?)3(?: 0)?
gpl | gnu general public licen[cs]e
lgpl-2.0 | gnu library general public licen[cs]e (?:version |v ?)2(?: 0)?
lgpl-2.1 | gnu lesser general public licen[cs]e (?:version |v ?)2 1
lgpl-3.0 | gnu lesser general public licen[cs]e (?:version |v ?)3(?: 0)?
lgpl | gnu (?:lesser|library) general public licen[cs]e
lgpl-2.0 | lgpl ?(?:version |v ?)?2 0|lgplv2
lgpl-2.1-or-later | lgpl ?(?:version |v ?)?2 1 or (?:any )?later
lgpl-2.1 | lgpl ?(?:version |v ?)?2 1|lgplv2 1
lgpl-3.0-or-later | lgpl ?(?:version |v ?)?3(?: 0)? or (?:any )?later
lgpl-3.0 | lgpl ?(?:version |v ?)?3(?: 0)?|lgplv3
agpl-3.0 | gnu affero general public licen[cs]e (?:version |v ?)3(?: 0)?
agpl | (?:gnu )?affero general public licen[cs]e
agpl-3.0-or-later | agpl ?(?:version |v ?)?3(?: 0)? or (?:any )?later
agpl-3.0 | agpl ?(?:version |v ?)?3(?: 0)?|agplv3
gfdl-1.1 | gnu free documentation licen[cs]e (?:version |v ?)1 1
gfdl-1.2 | gnu free documentation licen[cs]e (?:version |v ?)1 2
gfdl-1.3 | gnu free documentation licen[cs]e (?:version |v ?)1 3
gfdl | gnu free documentation licen[cs]e
mpl-1.0 | mozilla public licen[cs]e (?:version |v ?)?1 0
mpl-1.1 | mozilla public licen[cs]e (?:version |v ?)?1 1
mpl-2.0 | mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
mpl | mozilla public licen[cs]e
mpl-1.1 | mpl ?(?:version |v ?)?1 1
mpl-2.0 | mpl ?(?:version |v ?)?2 0
epl-1.0 | eclipse public licen[cs]e (?:version |v ?)?1 0
epl-2.0 | eclipse public licen[cs]e (?:version |v ?)?2 0
epl | eclipse public licen[cs]e
edl-1.0 | eclipse distribution licen[cs]e(?: (?:version |v ?)?1 0)?
cddl-1.0 | cddl ?(?:version |v ?)?1 0
cddl-1.1 | cddl ?(?:version |v ?)?1 1
cddl | common development and distribution licen[cs]e
cpl-1.0 | common public licen[cs]e(?: (?:version |v ?)?1 0)?
cpal-1.0 | common public attribution licen[cs]e(?: (?:version |v ?)?1 0)?
ipl-1.0 | ibm public licen[cs]e(?: (?:version |v ?)?1 0)?
eupl-1.1 | european union public licen[cs]e (?:version |v ?)?1 1
eupl-1.2 | european union public licen[cs]e (?:version |v ?)?1 2
eupl | european union public licen[cs]e
osl-3.0 | open software licen[cs]e(?: (?:version |v ?)?3 0)?
afl-3.0 | academic free licen[cs]e(?: (?:version |v ?)?3 0)?
artistic-1.0 | artistic licen[cs]e (?:version |v ?)?1 0
artistic-2.0 | artistic licen[cs]e (?:version |v ?)?2 0
artistic | artistic licen[cs]e
bsl-1.0 | boost software licen[cs]e(?: (?:version |v ?)?1 0)?
zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng licen[cs]e
openssl | openssl licen[cs]e
ssleay | ssleay licen[cs]e
php-3.01 | php licen[cs]e(?: (?:version |v ?)?3 01)?
python-2.0 | python software foundation licen[cs]e(?: version 2)?|psf licen[cs]e
ruby | ruby licen[cs]e|ruby s licen[cs]e
postgresql | postgresql licen[cs]e
ncsa | university of illinois ncsa open source licen[cs]e
ncsa | ncsa licen[cs]e
upl-1.0 | universal permissive licen[cs]e(?: (?:version |v ?)?1 0)?
w3c | w3c software (?:notice and )?licen[cs]e
unlicense | the unlicense|unlicense licen[cs]e
wtfpl | wtfpl(?: (?:version |v ?)?2)?
ofl-1.0 | sil open font licen[cs]e (?:version |v ?)?1 0
ofl-1.1 | sil open font licen[cs]e(?: (?:version |v ?)?1 1)?
ms-pl | microsoft public licen[cs]e
ms-rl | microsoft reciprocal licen[cs]e
apsl-2.0 | apple public source licen[cs]e(?: (?:version |v ?)?2 0)?
qpl-1.0 | q public licen[cs]e(?: (?:version |v ?)?1 0)?
sspl-1.0 | server side public licen[cs]e(?: (?:version |v ?)?1)?
busl-1.1 | business source licen[cs]e(?: (?:version |v ?)?1 1)?
elastic-2.0 | elastic licen[cs]e(?: (?:version |v ?)?2 0)?
mulan-psl-2.0 | mulan permissive software licen[cs]e(?: (?:version |v ?)?2)?
cecill-2.1 | cecill(?: free software)? licen[cs]e(?: agreement)?(?: (?:version |v ?)?2 1)?
odbl-1.0 | open database licen[cs]e(?: (?:version |v ?)?1 0)?
odc-by-1.0 | open data commons attribution licen[cs]e(?: (?:version |v ?)?1 0)?
pddl-1.0 | open data commons public domain dedication(?: and licen[cs]e)?
cern-ohl | cern open hardware licen[cs]e
ecl-2.0 | educational community licen[cs]e(?: (?:version |v ?)?2 0)?
eudatagrid | eu datagrid software licen[cs]e
hpnd | historical permission notice and disclaimer
intel | intel open source licen[cs]e
lppl-1.3c | latex project public licen[cs]e(?: (?:version |v ?)?1 3c)?|lppl (?:version |v ?)?1 3c
nasa-1.3 | nasa open source agreement(?: (?:version |v ?)?1 3)?
nokia | nokia open source licen[cs]e
ntp | ntp licen[cs]e
oclc-2.0 | oclc research public licen[cs]e(?: 2 0)?
rpl-1.5 | reciprocal public licen[cs]e(?: (?:version |v ?)?1 5)?
rpsl-1.0 | realnetworks public source licen[cs]e
simpl-2.0 | simple public licen[cs]e(?: 2 0)?
sleepycat | sleepycat licen[cs]e|berkeley database licen[cs]e
spl-1.0 | sun public licen[cs]e(?: (?:version |v ?)?1 0)?
vim | vim licen[cs]e
vsl-1.0 | vovida software licen[cs]e
watcom-1.0 | sybase open watcom public licen[cs]e
xnet | x net licen[cs]e
zpl-2.1 | zope public licen[cs]e(?: (?:version |v ?)?2 1)?
blueoak-1.0.0 | blue oak model licen[cs]e
parity-7.0.0 | parity public licen[cs]e
polyform-noncommercial | polyform noncommercial licen[cs]e
polyform-small-business | polyform small business licen[cs]e
prosperity | prosperity public licen[cs]e
hippocratic | hippocratic licen[cs]e
anti-capitalist | anti capitalist software licen[cs]e
fair-source | fair source licen[cs]e|functional source licen[cs]e
commons-clause | commons clause(?: licen[cs]e)?(?: condition)?
freetype | freetype (?:project )?licen[cs]e
imagemagick | imagemagick licen[cs]e
info-zip | info zip licen[cs]e
ijg | independent jpeg group(?: s)? (?:licen[cs]e|software)
curl | curl licen[cs]e
tcl | tcl tk licen[cs]e|tcl licen[cs]e
unicode | unicode licen[cs]e agreement|unicode terms of use|unicode licen[cs]e v3
cdla-permissive | community data licen[cs]e agreement permissive(?: (?:version |v ?)?[12] 0)?
cdla-sharing | community data licen[cs]e agreement sharing(?: (?:version |v ?)?1 0)?
etalab-2.0 | licence ouverte(?: (?:version |v ?)?2 0)?|etalab open licen[cs]e
dl-de-by-2.0 | data licen[cs]e germany attribution(?: (?:version |v ?)?2 0)?
gemma | gemma terms of use
stability-community | stability ai community licen[cs]e
ogl-uk-3.0 | open government licen[cs]e(?: (?:version |v ?)?3 0)?
openrail | (?:creativeml )?openrail(?: ?m)?(?: licen[cs]e)?|(?:creativeml )?open rail(?: ?m)?(?: licen[cs]e)?
llama-community | llama [23] (?:[0-9] )?community licen[cs]e(?: agreement)?
cc0-1.0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creative commons (?:zero|public domain dedication)
"""

#: label | text that is typical of the license itself
CLAUSES = """
mit | permission is hereby granted free of charge to any person obtaining a copy
mit | deal in the software without restriction including without limitation the rights
isc | permission to use copy modify and or distribute this software for any purpose with or without fee
bsd | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | redistributions of source code must retain the above copyright notice
bsd-3-clause | (?:be used|used) to endorse or promote products derived from this software
bsd-4-clause | all advertising materials mentioning features or use of this software
gpl | as published by the free software foundation
gpl | this program is free software you can redistribute it and or modify it
gpl-or-later | either version [123](?: [01])? of the license or at your option any later version
lgpl | this library is free software you can redistribute it and or modify it
apache-2.0 | licensed under the apache license version 2 0 the license
apache-2.0 | www apache org licenses license 2 0
mpl-2.0 | subject to the terms of the mozilla public license v ?2 0
mpl-1.1 | subject to the mozilla public license version 1 1
epl-1.0 | made available under the terms of the eclipse public license v ?1 0
epl-2.0 | made available under the terms of the eclipse public license ?v? ?2 0
bsl-1.0 | distributed under the boost software license version 1 0
zlib | this software is provided as is without any express or implied warranty
unlicense | this is free and unencumbered software released into the public domain
wtfpl | do what the fuck you want to
public-domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain | public domain dedication
cc-by | creativecommons org licenses by [1234] [05]
cc-by-sa | creativecommons org licenses by sa [1234] [05]
cc-by-nc | creativecommons org licenses by nc [1234] [05]
cc-by-nd | creativecommons org licenses by nd [1234] [05]
cc-by-nc-sa | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | creativecommons org licenses by nc nd [1234] [05]
cc0-1.0 | creativecommons org publicdomain zero 1 0
openssl | this product includes software developed by the openssl project
ssleay | this product includes cryptographic software written by eric young
free-unknown | (?:redistribute|distributed|modify) it under the same terms as perl itself
proprietary | all rights reserved
proprietary | proprietary and confidential
proprietary | (?:this is|contains) proprietary (?:software|information)
commercial | (?:under|requires|purchase) an? commercial licen[cs]e
non-commercial | for non commercial (?:use|purposes) only
apache-1.1 | this product includes software developed by the apache software foundation
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | you may not use this file except in compliance with the license
apache-2.0 | licensed to the apache software foundation asf under one or more contributor license agreements
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
isc | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
isc | the author disclaims all warranties with regard to this software
bsd | this software is provided by the (?:copyright holders|regents|authors?|project)(?: and contributors)? as is
bsd | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | neither the name of [a-z0-9 ]{1,60} nor the names of its contributors
bsd-4-clause | this product includes software developed by the university of california
gpl | this program is distributed in the hope that it will be useful
gpl | you should have received a copy of the gnu general public license
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license
agpl | you should have received a copy of the gnu affero general public license
gpl | everyone is permitted to copy and distribute verbatim copies of this license document
gpl-2.0 | gnu general public license version 2 june 1991
gpl-3.0 | gnu general public license version 3 29 june 2007
lgpl-2.1 | gnu lesser general public license version 2 1 february 1999
agpl-3.0 | gnu affero general public license version 3 19 november 2007
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | this source code form is subject to the terms of the mozilla public license
mpl | the contents of this file are subject to the mozilla public license
epl | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl | the contents of this file are subject to the terms of the common development and distribution license
zlib | altered source versions must be plainly marked as such
zlib | the origin of this software must not be misrepresented
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document
cc0-1.0 | to the extent possible under law
cc-by | you must give appropriate credit provide a link to the license
cc-by-sa | you must distribute your contributions under the same license as the original
cc-by-nc | you may not use the material for commercial purposes
cc-by-nd | you may not distribute the modified material
artistic | the intent of this document is to state the conditions under which a package may be copied
ofl-1.1 | this font software is licensed under the sil open font license
ofl-1.1 | the font software may not be sold by itself
python-2.0 | this license agreement is between the python software foundation
php-3.01 | this product includes php software freely available from
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
openssl | redistributions of any form whatsoever must retain the following acknowledgment
ms-pl | this license governs use of the accompanying software
sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service
commons-clause | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
eupl | licensed under the eupl
json | the software shall be used for good not evil
beerware | you can buy me a beer in return
openrail | use based restrictions as referenced in paragraph
llama-community | built with (?:meta )?llama
ogl-uk-3.0 | contains public sector information licensed under the open government licen[cs]e
proprietary | no part of this (?:publication|document|work|book) may be reproduced
proprietary | unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|software|material)
proprietary | for internal use only
proprietary | may not be (?:copied|reproduced|distributed)(?: or [a-z]+)? without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)
non-commercial | (?:may|shall|can) not be used for commercial purposes
non-commercial | personal and non commercial use
non-commercial | for research purposes only
no-ai-training | may not be used to train (?:artificial intelligence|ai|machine learning|language) models?
warranty-disclaimer | without warranty of any kind
warranty-disclaimer | without warranties or conditions of any kind
"""

#: Words of the public licenses by attribution: tag to name.
CC_PARTS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s?", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: SPDX identifiers that are not the label itself.
SPDX = (("bsd-patent", "bsd 2 clause patent"), ("mulan-psl-2.0", "mulanpsl 2 0"), ("python-2.0", "psf 2 0"))


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    weight: float
    gate: bytes
    pattern: re.Pattern
    base: bool = False


#: What stands in many texts and makes a poor gate.
_COMMON = re.compile(r"\b(?:licen|e|only|or|any|later|version|v|of|the|\d+)\b| ")


def _rows(table: str):
    return [[x.strip() for x in line.split(" | ")] for line in table.strip().splitlines()]


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at each | that stands outside of groups."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def gate_of(pattern: str) -> str:
    """The text that stands in everything the pattern (one alternative) matches; of several, the one longest in rare words."""
    n = 1
    while n:
        pattern, n = re.subn(r"\([^()]*\)\??", "\0", pattern)
    return max(re.sub(r"\[[^]]*\](?:\?|\+|\{[^}]*\})?|[^\0]\?", "\0", pattern).split("\0"), key=lambda x: (len(_COMMON.sub("", x)), len(x)))


def rules() -> list[Rule]:
    """All rules, highest priority first: base phrases, notices and tags, license texts, then bare names."""
    out: list[Rule] = []

    def add(kind, label, gate, pattern, priority, weight, base=False):
        out.append(Rule(f"{kind}-{len(out)}", label, priority, weight, gate.encode(), re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )"), base))

    for label, phrase in BASE:
        add("base", label, phrase, phrase, 50, 1.0, True)
    names = _rows(NAMES)
    ids = [*dict.fromkeys((label, re.sub("[-.]", " ", label)) for label, _ in names), *SPDX]
    for part, name in CC_PARTS.items():
        tag = "cc-" + part.replace(" ", "-")
        for v in CC_VERSIONS:
            names.append((f"{tag}-{v.replace(' ', '.')}", f"cc {part} {v}"))
            names.append((f"{tag}-{v.replace(' ', '.')}", f"creative commons {name} {v}"))
        names.append((tag, f"cc {part}(?! (?:nc|nd|sa) )"))
        names.append((tag, f"creative commons {name}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"))
    names = [(label, one) for label, pattern in names for one in alternatives(pattern)]
    for label, pattern in [*ids, *names]:
        add("tag", label, "spdx licen", f"spdx licen[cs]e identifier (?:{pattern})", 40, 1.0)
    for label, pattern in names:
        add("notice", label, gate_of(pattern), f"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the |a )?(?:{pattern})", 30, 0.9)
    for label, pattern in _rows(CLAUSES):
        add("text", label, gate_of(pattern), pattern, 20, 0.8)
    for label, pattern in names:
        add("name", label, gate_of(pattern), pattern, 10, 0.6)
    return sorted(out, key=lambda r: -r.priority)
