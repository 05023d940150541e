"""Signature rules for licences, in the order in which they count.

One rule a line: ``label | keywords | pattern``. A pattern is matched against a text's words joined by single
blanks, from a word's first character to a word's last. A rule is tried only where all its keywords
are among the text's words. Sections run from what is certain to what is a hint; within a section
earlier rules count before later ones. ``{u}`` stands for the ways of saying that something is licensed under terms.
"""

from __future__ import annotations

from dataclasses import dataclass

UNDER = r"(?:licensed|released|distributed|redistributed|available|published|provided|covered|offered|shared|governed|issued) (?:to you )?(?:only )?(?:under|by) (?:the |a |an )?(?:terms (?:and conditions )?of (?:the |a )?)?"

#: The phrases every scan reports; nothing suppresses them.
BASE = """
mit | under mit license | under the mit license
apache-2 | apache license version 2 | apache license version 2
cc-by-nc | cc by nc | cc by nc
"""

#: Sentences of the licences' own texts and notices.
TEXTS = r"""
mit | hereby granted charge deal | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | substantial portions copyright permission | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
mit | holders authors | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-0 | hereby granted restriction sell | permission is hereby granted free of charge (?:\S+ ){10,60}without restriction (?:\S+ ){5,30}sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
x11 | advertising sale dealings | except as contained in this notice the name of (?:the )?(?:x consortium|\S+(?: \S+){0,4}) shall not be used in advertising or otherwise to promote the sale use or other dealings
isc | permission fee distribute purpose hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | permission fee purpose hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-4-clause | advertising materials acknowledgement features | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause | neither contributors endorse promote derived | neither the name of (?:the )?\S+(?: \S+){0,8} nor the names of (?:its|his|their) contributors may be used to endorse or promote products derived from this software
bsd-2-clause | redistributions binary reproduce materials | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
bsd-2-clause | redistributions retain disclaimer conditions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
apache-2 | licensed compliance file apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | unless applicable writing basis | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | perpetual worldwide royalty irrevocable contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1 | apache foundation developed | this product includes software developed by the apache software foundation
gpl-3-or-later | published foundation general | it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2-or-later | published foundation general | it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-1-or-later | published foundation general | it under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version
gpl-3-only | published foundation general version 3 | it under the terms of the gnu general public license as published by the free software foundation version 3
gpl-2-only | published foundation general version 2 | it under the terms of the gnu general public license as published by the free software foundation version 2
gpl | general public free | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | warranty merchantability gnu general | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
lgpl-3-or-later | lesser published foundation version 3 | it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later | lesser published foundation version 2 1 | it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-2-or-later | library published foundation version 2 | it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl | merchantability gnu general | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license for more details
lgpl-3 | lesser incorporates terms | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
agpl-3-or-later | affero published foundation version 3 | it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3 | affero cooperation | the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation
gfdl | document free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 | source subject mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | contents subject mozilla version 1 | the contents of this file are subject to the mozilla public license version 1 1 the license
mpl-1.0 | contents subject mozilla version 1 | the contents of this file are subject to the mozilla public license version 1 0 the license
npl-1.1 | contents subject netscape version 1 | the contents of this file are subject to the netscape public license version 1 [01]
epl-2 | accompanying materials eclipse available | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
epl-1 | accompanying materials eclipse available | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v1 0|v 1 0|1 0)
edl-1 | accompanying materials eclipse distribution available | this program and the accompanying materials are made available under the terms of the eclipse distribution license (?:v1 0|v 1 0|1 0)
cpl-1 | accompanying materials common v1 available | this program and the accompanying materials are made available under the terms of the common public license v1 0
cddl-1 | contents subject common development distribution | the contents of this file are subject to the terms of the common development and distribution license
unlicense | unencumbered released public domain free | this is free and unencumbered software released into the public domain
unlicense | anyone copy modify publish purpose | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose
wtfpl | fuck want public license | do what the fuck you want to public license
cc0-1.0 | waived copyright neighboring rights extent | to the extent possible under law (?:\S+ ){1,12}?(?:has|have) waived all copyright and related or neighboring rights
cc0-1.0 | affirmer overtly waives abandons surrenders | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
zlib | misrepresented origin claim | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered plainly marked misrepresented original | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | png supplied reference | the png reference library is supplied as is
boost-1 | obtaining organization accompanying covered license | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
python-2 | psf licensee foundation python agreement | this license agreement is between the python software foundation psf and the individual or organization licensee
psf-2 | psf hereby grants licensee nonexclusive | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce
artistic-2 | preamble verbatim package | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package may be copied
artistic-1 | semblance artistic control package | the copyright holder maintains some semblance of artistic control over the development of the package
openssl | openssl project toolkit developed product | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric young cryptographic | this product includes cryptographic software written by eric young
curl | daniel stenberg permission | copyright c (?:\S+ ){1,6}daniel stenberg (?:\S+ ){0,12}all rights reserved permission to use copy modify and distribute
postgresql | written agreement fee | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ntp | university delaware suitability | the university of delaware makes no representations about the suitability this software for any purpose
hpnd | fee hereby granted documentation | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted without fee|and without fee is hereby granted)
ofl-1.1 | reserved fonts | the fonts and derivatives however can be bundled embedded redistributed and or sold with any software provided that any reserved names are not used
ofl-1.1 | font software sil open licensed | this font software is licensed under the sil open font license version 1 1
ijg | independent jpeg group software based | this software is based in part on the work of the independent jpeg group
freetype | freetype project portions | portions of this software are copyright c (?:\S+ ){1,6}the freetype project
unicode-dfs | unicode data files hereby granted | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
ms-pl | accept if use | if you use the software you accept this license if you do not accept the license do not use the software
beerware | beer buy worth meet | if we meet some day and you think this stuff is worth it you can buy me a beer in return
eupl | eupl | licensed under the eupl (?:version )?1 [12]
cecill | cecill license governed french law | this software is governed by the cecill(?: [bc])? license under french law
upl-1 | universal permissive license | the universal permissive license upl version 1 0
jsonlic | evil good shall used software | the software shall be used for good not evil
commons-clause | condition | the software is provided to you by the licensor under the license as defined below subject to the following condition
sspl-1 | service source | if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
busl-1.1 | licensor production derivative | licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic-2 | hosted managed substantial features | you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features
openrail-m | restrictions | use based restrictions as referenced in paragraph 5
llama-2 | llama agreement community | llama 2 community license agreement
proprietary | unauthorized strictly | unauthorized copying of this file via any medium is strictly prohibited
proprietary | reproduced | no part of this (?:publication|book|document|work) may be reproduced (?:\S+ ){0,24}without (?:the )?(?:express )?(?:prior )?(?:written )?(?:permission|consent)
"""

#: Statements that a work is under a licence, and machine-readable tags.
STATEMENTS = r"""
gpl-3 | gnu general public 3 | {u}gnu general public license (?:gpl )?(?:as published by the free software foundation )?(?:version |v )?3(?: 0)?
gpl-2 | gnu general public 2 | {u}gnu general public license (?:gpl )?(?:version |v )?2(?: 0)?
gpl | gnu general public | {u}gnu general public license(?: gpl)?
lgpl-3 | gnu lesser general 3 | {u}gnu lesser general public license (?:lgpl )?(?:version |v )?3(?: 0)?
lgpl-2.1 | gnu lesser general 2 1 | {u}gnu lesser general public license (?:lgpl )?(?:version |v )?2 1
lgpl | gnu lesser general | {u}gnu lesser general public license
agpl-3 | gnu affero general | {u}gnu affero general public license(?: (?:version |v )?3(?: 0)?)?
gfdl | gnu free documentation | {u}gnu free documentation license(?: (?:version )?1 [123])?
mit | mit | {u}mit(?: x11)? licen[sc]e
mit | expat | {u}expat (?:mit )?licen[sc]e
apache-2 | apache 2 | {u}apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
apache-2 | apache 2 | {u}apache 2(?: 0)?(?: licen[sc]e)?
apache | apache | {u}apache (?:software )?licen[sc]e
bsd-3-clause | bsd 3 | {u}(?:bsd 3 clause|3 clause bsd)(?: licen[sc]e)?
bsd-3-clause | bsd | {u}(?:three clause bsd|new bsd)(?: licen[sc]e)?
bsd-2-clause | bsd 2 | {u}(?:bsd 2 clause|2 clause bsd)(?: licen[sc]e)?
bsd | bsd | {u}(?:modified |simplified |new )?bsd (?:style )?licen[sc]e
mpl-2 | mozilla public 2 | {u}mozilla public licen[sc]e (?:mpl )?(?:version |v )?2(?: 0)?
mpl | mozilla public | {u}mozilla public licen[sc]e
epl-2 | eclipse public 2 | {u}eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl | eclipse public | {u}eclipse public licen[sc]e
isc | isc | {u}isc licen[sc]e
zlib | zlib | {u}zlib(?: libpng)? licen[sc]e
boost-1 | boost | {u}boost software licen[sc]e(?: version 1 0)?
unlicense | unlicense | {u}unlicense
wtfpl | wtfpl | {u}wtfpl
artistic-2 | artistic 2 | {u}artistic licen[sc]e (?:version )?2(?: 0)?
artistic | artistic | {u}artistic licen[sc]e
perl | perl same terms | (?:redistribute it and or modify it )?under the same terms as perl(?: itself)?
python | python same terms | under the same terms as python(?: itself)?
eupl | eupl | {u}eupl
ofl-1.1 | sil open font | {u}sil open font licen[sc]e(?: version 1 1)?
odbl-1 | open database | {u}open database licen[sc]e(?: odbl)?(?: (?:v|version )?1 0)?
odc-by-1 | open data commons attribution | {u}open data commons attribution licen[sc]e
pddl-1 | open data commons dedication | {u}open data commons public domain dedication(?: and licen[sc]e)?
ogl-3 | open government | {u}open government licen[sc]e(?: (?:v|version )?[123](?: 0)?)?
cc0-1.0 | cc0 | {u}(?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by-nc-nd-4.0 | cc by nc nd 4 | {u}cc by nc nd 4 0
cc-by-nc-sa-4.0 | cc by nc sa 4 | {u}cc by nc sa 4 0
cc-by-nc-4.0 | cc by nc 4 | {u}cc by nc 4 0
cc-by-nd-4.0 | cc by nd 4 | {u}cc by nd 4 0
cc-by-sa-4.0 | cc by sa 4 | {u}cc by sa 4 0
cc-by-sa-3.0 | cc by sa 3 | {u}cc by sa 3 0
cc-by-4.0 | cc by 4 | {u}cc by 4 0
cc-by-3.0 | cc by 3 | {u}cc by 3 0
cc-by-nc-nd | creative commons attribution noncommercial noderivatives | {u}creative commons attribution noncommercial noderivatives(?: \d \d)?(?: international)?(?: licen[sc]e)?
cc-by-nc-nd | creative commons attribution | {u}creative commons attribution non commercial no derivatives(?: \d \d)?
cc-by-nc-sa | creative commons attribution noncommercial sharealike | {u}creative commons attribution noncommercial sharealike(?: \d \d)?(?: international)?(?: licen[sc]e)?
cc-by-nc-sa | creative commons attribution commercial share alike | {u}creative commons attribution non commercial share alike(?: \d \d)?
cc-by-nc | creative commons attribution noncommercial | {u}creative commons attribution noncommercial(?: \d \d)?(?: international)?(?: licen[sc]e)?
cc-by-nc | creative commons attribution commercial | {u}creative commons attribution non commercial(?: \d \d)?
cc-by-sa | creative commons attribution sharealike | {u}creative commons attribution sharealike(?: \d \d)?(?: international| unported)?(?: licen[sc]e)?
cc-by-sa | creative commons attribution share alike | {u}creative commons attribution share alike(?: \d \d)?
cc-by-nd | creative commons attribution | {u}creative commons attribution no derivatives(?: \d \d)?
cc-by | creative commons attribution | {u}creative commons attribution(?: \d \d)?(?: international| unported)?(?: licen[sc]e)?
creative-commons | creative commons | {u}creative commons licen[sc]e
public-domain | public domain | (?:released into|placed in|dedicated to|belongs to|is in|are in) the public domain
mit | spdx identifier mit | spdx license identifier mit
apache-2 | spdx identifier apache | spdx license identifier apache 2 0
gpl-3-or-later | spdx identifier gpl 3 | spdx license identifier gpl 3 0 or later
gpl-3-only | spdx identifier gpl 3 | spdx license identifier gpl 3 0(?: only)?
gpl-2-or-later | spdx identifier gpl 2 | spdx license identifier gpl 2 0 or later
gpl-2-only | spdx identifier gpl 2 | spdx license identifier gpl 2 0(?: only)?(?: with linux syscall note)?
lgpl-2.1-or-later | spdx identifier lgpl 2 1 | spdx license identifier lgpl 2 1 or later
lgpl-2.1-only | spdx identifier lgpl 2 1 | spdx license identifier lgpl 2 1(?: only)?
lgpl-3-or-later | spdx identifier lgpl 3 | spdx license identifier lgpl 3 0 or later
agpl-3-or-later | spdx identifier agpl 3 | spdx license identifier agpl 3 0 or later
agpl-3-only | spdx identifier agpl 3 | spdx license identifier agpl 3 0(?: only)?
bsd-3-clause | spdx identifier bsd 3 | spdx license identifier bsd 3 clause
bsd-2-clause | spdx identifier bsd 2 | spdx license identifier bsd 2 clause
mpl-2 | spdx identifier mpl | spdx license identifier mpl 2 0
epl-2 | spdx identifier epl | spdx license identifier epl 2 0
isc | spdx identifier isc | spdx license identifier isc
cc0-1.0 | spdx identifier cc0 | spdx license identifier cc0 1 0
cc-by-4.0 | spdx identifier cc by | spdx license identifier cc by 4 0
unlicense | spdx identifier unlicense | spdx license identifier unlicense
zlib | spdx identifier zlib | spdx license identifier zlib
boost-1 | spdx identifier bsl | spdx license identifier bsl 1 0
dual | dual licensed | dual licensed under
proprietary | proprietary confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | rights reserved | all rights reserved
"""

#: Names of licences and addresses of their texts.
NAMES = r"""
gpl-3 | gnu general public 3 | gnu general public licen[sc]e (?:gpl )?(?:version |v )?3(?: 0)?
gpl-2 | gnu general public 2 | gnu general public licen[sc]e (?:gpl )?(?:version |v )?2(?: 0)?
gpl | gnu general public | gnu general public licen[sc]e
lgpl-3 | gnu lesser general 3 | gnu lesser general public licen[sc]e (?:version |v )?3(?: 0)?
lgpl-2.1 | gnu lesser general 2 1 | gnu lesser general public licen[sc]e (?:version |v )?2 1
lgpl | gnu general | gnu (?:lesser|library) general public licen[sc]e
lgpl | gnu library general | gnu library general public licen[sc]e
agpl-3 | affero general public | (?:gnu )?affero general public licen[sc]e
gfdl | gnu free documentation | gnu free documentation licen[sc]e
mit | mit | mit licen[sc]e
mit | expat | expat licen[sc]e
apache-2 | apache 2 | apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
apache-1.1 | apache 1 | apache (?:software )?licen[sc]e (?:version |v )?1 1
apache | apache | apache (?:software )?licen[sc]e
bsd-3-clause | bsd 3 | (?:bsd 3 clause|3 clause bsd)
bsd-2-clause | bsd 2 | (?:bsd 2 clause|2 clause bsd)
bsd-4-clause | bsd 4 | (?:bsd 4 clause|4 clause bsd)
bsd | bsd | bsd (?:style )?licen[sc]e
mpl-2 | mozilla public 2 | mozilla public licen[sc]e (?:version |v )?2(?: 0)?
mpl-1.1 | mozilla public 1 | mozilla public licen[sc]e (?:version |v )?1 1
mpl | mozilla public | mozilla public licen[sc]e
npl | netscape public | netscape public licen[sc]e
epl | eclipse public | eclipse public licen[sc]e
edl-1 | eclipse distribution | eclipse distribution licen[sc]e
cpl-1 | common public | common public licen[sc]e
cddl | common development distribution | common development and distribution licen[sc]e
ibm-pl | ibm public | ibm public licen[sc]e
isc | isc | isc licen[sc]e
zlib | zlib | zlib (?:libpng )?licen[sc]e
boost-1 | boost software | boost software licen[sc]e
unlicense | unlicense | unlicense
wtfpl | wtfpl | wtfpl
artistic | artistic | artistic licen[sc]e
clarified-artistic | clarified artistic | clarified artistic licen[sc]e
psf | python foundation | python software foundation licen[sc]e
ruby | ruby | ruby licen[sc]e
php-3 | php | php licen[sc]e(?: (?:version |v )?3 0?1?)?
postgresql | postgresql | postgresql licen[sc]e
openssl | openssl | openssl licen[sc]e
ofl-1.1 | open font | (?:sil )?open font licen[sc]e
eupl | european union public | european union public licen[sc]e
cecill | cecill | cecill(?: [abc])?(?: licen[sc]e)?
ms-pl | microsoft public | microsoft public licen[sc]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e
osl-3 | open software | open software licen[sc]e(?: (?:version |v )?3 0)?
afl-3 | academic free | academic free licen[sc]e(?: (?:version |v )?3 0)?
upl-1 | universal permissive | universal permissive licen[sc]e
vim | vim | vim licen[sc]e
beerware | beerware | beerware licen[sc]e
sspl-1 | server side public | server side public licen[sc]e
busl-1.1 | business source | business source licen[sc]e
elastic-2 | elastic | elastic licen[sc]e
polyform | polyform | polyform (?:noncommercial|shield|small business|perimeter|strict) licen[sc]e
hippocratic | hippocratic | hippocratic licen[sc]e
parity | parity public | parity public licen[sc]e
mulan-psl-2 | mulan | mulan (?:psl|permissive software licen[sc]e)
openrail | openrail | (?:bigscience |creativeml |bigcode )?openrail(?: m)?
llama | llama community | llama (?:\d )?(?:\d )?community licen[sc]e
gemma | gemma terms use | gemma terms of use
odbl-1 | open database | open database licen[sc]e
odbl-1 | odbl | odbl
ogl | open government | open government licen[sc]e
cdla-permissive | community data permissive | community data licen[sc]e agreement permissive
cdla-sharing | community data sharing | community data licen[sc]e agreement sharing
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nd | cc by nd | cc by nd
cc-by-sa | cc by sa | cc by sa
cc-by | cc by | cc by \d \d
cc0-1.0 | cc0 | cc0(?: 1 0)?
creative-commons | creative commons | creative commons(?: licen[sc]e)?
mit | opensource org licenses mit | opensource org licenses mit(?: license php)?
bsd-3-clause | opensource org licenses bsd | opensource org licenses bsd 3 clause
apache-2 | apache org licenses | (?:www )?apache org licenses license 2 0
gpl | gnu org licenses | (?:www )?gnu org licenses(?: (?:gpl|old licenses gpl 2 0)(?: 3 0)?(?: html| txt)?)?
cc-by | creativecommons org licenses | creativecommons org licenses by \d \d
cc-by-sa | creativecommons org licenses sa | creativecommons org licenses by sa \d \d
cc-by-nc | creativecommons org licenses nc | creativecommons org licenses by nc \d \d
cc-by-nc-sa | creativecommons org licenses nc sa | creativecommons org licenses by nc sa \d \d
cc-by-nd | creativecommons org licenses nd | creativecommons org licenses by nd \d \d
cc-by-nc-nd | creativecommons org licenses nc nd | creativecommons org licenses by nc nd \d \d
cc0-1.0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
public-domain | creativecommons org publicdomain mark | creativecommons org publicdomain mark 1 0
mpl-2 | mozilla org mpl | (?:www )?mozilla org (?:en us )?mpl(?: 2 0)?
unlicense | unlicense org | unlicense org
"""

#: Hints that a work is under some licence.
HINTS = r"""
gpl-3 | gplv3 | gplv3
gpl-2 | gplv2 | gplv2
gpl-3 | gpl 3 | gpl (?:v |version )?3(?: 0)?
gpl-2 | gpl 2 | gpl (?:v |version )?2(?: 0)?
gpl | gpl | gpl
lgpl | lgpl | lgpl(?: (?:v |version )?[23](?: [01])?)?
lgpl-3 | lgplv3 | lgplv3
agpl-3 | agplv3 | agplv3
agpl-3 | agpl | agpl(?: (?:v |version )?3(?: 0)?)?
mpl-2 | mpl 2 | mpl 2 0
copyleft | copyleft | copyleft
open-source | open source | open source licen[sc]e
permissive | permissive | permissive licen[sc]e
non-commercial | noncommercial use only | noncommercial use only
non-commercial | non commercial use only | non commercial use only
non-commercial | commercial prohibited | commercial (?:use|purposes) (?:is|are) (?:strictly )?prohibited
research-only | research purposes only | for (?:academic )?research purposes only
evaluation-only | evaluation purposes only | for evaluation purposes only
copyright | copyright c | copyright c (?:19|20)\d\d
copyright | copyright | copyright (?:19|20)\d\d
see-license | see | see (?:the )?(?:accompanying )?licen[sc]e (?:file|txt|md)
"""


@dataclass(frozen=True)
class Rule:
    """``priority``: a higher one may suppress a lower one. ``confidence``: that the text has the licence."""

    label: str
    keys: frozenset[bytes]
    pattern: bytes
    priority: int
    confidence: float
    base: bool = False


def parsed(block: str, priority: int, confidence: float, base: bool = False) -> list[Rule]:
    found = []
    for line in block.strip().splitlines():
        label, keys, pattern = (part.strip() for part in line.split(" | ", 2))
        body = pattern.replace("{u}", UNDER)
        found.append(Rule(label, frozenset(k.encode() for k in keys.split()), rf"(?<= )(?:{body})(?= )".encode(), priority, confidence, base))
    return found


RULES = [
    *parsed(BASE, 4, 0.9, base=True), *parsed(TEXTS, 3, 0.99), *parsed(STATEMENTS, 2, 0.95), *parsed(NAMES, 1, 0.8), *parsed(HINTS, 0, 0.4),
]
