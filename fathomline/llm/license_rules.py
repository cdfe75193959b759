"""Signature rules of licences, written over words: lower case, single spaces, marks gone ("2.0" reads "2 0")."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SignatureRule:
    """``pattern`` is tried where a text contains ``keyword``, or one of several parted by ``|``; a smaller ``priority`` is stronger.

    Every match holds one of the keywords.
    """

    label: str
    priority: int
    keyword: str
    pattern: str


#: Every rule's match holds one of these, as part of a word; ``cc`` and ``cc0`` as words.
STEMS = (
    "licen", "copyright", "reserved", "permission", "redistribut", "warrant", "unencumbered", "endorse", "advertising", "complian",
    "accompanying", "verbatim", "public", "proprietary", "commercial", "research", "creative", "terms", "source code",
)
#: Priorities, strongest first, with the confidence of a detection.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.6, 6: 0.4}

# Fixed values, written for these rules: label; keyword; the licence's names; its short names in tags; its web pages.
NAMES = """
mit; mit|expat; (?:mit|expat) licen[cs]e; mit; opensource org licenses mit
mit-0; mit no attribution; mit no attribution licen[cs]e; mit 0; opensource org licenses mit 0
apache-1.0; apache; apache licen[cs]e(?: version| v)? 1 0; apache 1 0; apache org licenses license 1 0
apache-1.1; apache; apache (?:software )?licen[cs]e(?: version| v)? 1 1; apache 1 1; apache org licenses license 1 1
apache-2.0; apache; apache (?:software )?licen[cs]e(?: version| v)?(?: 2(?: 0)?); apache 2 0; apache org licenses license 2 0
apache; apache; apache (?:software )?licen[cs]e; apache; apache org licenses
bsd-0; bsd; (?:zero clause bsd|bsd zero clause|0 clause bsd) licen[cs]e; 0bsd; opensource org licenses 0bsd
bsd-2; bsd|simplified; (?:2|two) clause bsd licen[cs]e|(?:simplified|freebsd) (?:bsd )?licen[cs]e; bsd 2 clause; opensource org licenses bsd 2 clause
bsd-3; bsd; (?:3|three) clause bsd licen[cs]e|(?:new|modified|revised) bsd licen[cs]e; bsd 3 clause; opensource org licenses bsd 3 clause
bsd-4; bsd; (?:4|four) clause bsd licen[cs]e|original bsd licen[cs]e; bsd 4 clause; spdx org licenses bsd 4 clause
bsd; bsd; bsd (?:style )?licen[cs]e; bsd; opensource org licenses bsd license
isc; isc; isc licen[cs]e; isc; opensource org licenses isc
zlib; zlib; zlib (?:libpng )?licen[cs]e; zlib; opensource org licenses zlib
libpng; libpng|png reference; (?:png reference library|libpng) licen[cs]e; libpng 2 0; libpng org pub png src libpng license
boost-1.0; boost; boost software licen[cs]e(?: version| v)?(?: 1 0)?; bsl 1 0; boost org license 1 0
unlicense; unlicen; unlicen[cs]e; unlicense; unlicense org
wtfpl; want to; do what the fuck you want to public licen[cs]e; wtfpl;
cc0-1.0; commons zero; creative commons zero(?: universal| public domain dedication)?(?: 1 0)?(?: universal)?; cc0 1 0;
gpl-1.0; general public; gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 1(?: 0)?; gpl 1 0; gnu org licenses old licenses gpl 1 0
gpl-2.0; general public; gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?; gpl 2 0; gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0; general public; gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?; gpl 3 0; gnu org licenses gpl 3 0
gpl; general public|gnu public; gnu (?:general )?public licen[cs]e|general public licen[cs]e; gpl; gnu org licenses gpl
lgpl-2.0; library general; gnu library general public licen[cs]e(?: version| v)?(?: 2(?: 0)?)?; lgpl 2 0; gnu org licenses old licenses lgpl 2 0
lgpl-2.1; lesser; gnu lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2 1; lgpl 2 1; gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0; lesser; gnu lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?; lgpl 3 0; gnu org licenses lgpl 3 0
lgpl; lesser; (?:gnu )?lesser general public licen[cs]e; lgpl; gnu org licenses lgpl
agpl-1.0; affero; affero general public licen[cs]e(?: version| v)? 1(?: 0)?; agpl 1 0;
agpl-3.0; affero; gnu affero general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?; agpl 3 0; gnu org licenses agpl 3 0
agpl; affero; (?:gnu )?affero general public licen[cs]e; agpl; gnu org licenses agpl
gfdl-1.3; documentation; gnu free documentation licen[cs]e(?: version| v)? 1 3; gfdl 1 3; gnu org licenses fdl 1 3
gfdl; documentation; gnu free documentation licen[cs]e; gfdl; gnu org licenses fdl
mpl-1.0; mozilla; mozilla public licen[cs]e(?: version| v)? 1 0; mpl 1 0;
mpl-1.1; mozilla; mozilla public licen[cs]e(?: version| v)? 1 1; mpl 1 1;
mpl-2.0; mozilla; mozilla public licen[cs]e(?: version| v)? 2(?: 0)?; mpl 2 0;
mpl; mozilla; mozilla public licen[cs]e; mpl;
epl-1.0; eclipse; eclipse public licen[cs]e(?: version| v)? 1 0; epl 1 0;
epl-2.0; eclipse; eclipse public licen[cs]e(?: version| v)? 2(?: 0)?; epl 2 0;
epl; eclipse; eclipse public licen[cs]e; epl;
edl-1.0; eclipse; eclipse distribution licen[cs]e; edl 1 0;
cddl-1.0; common development; common development and distribution licen[cs]e(?: version| v)?(?: 1 0)?; cddl 1 0; opensource org licenses cddl 1 0
cddl-1.1; common development; common development and distribution licen[cs]e(?: version| v)? 1 1; cddl 1 1;
cpl-1.0; common public; common public licen[cs]e(?: version| v)?(?: 1 0)?; cpl 1 0; opensource org licenses cpl 1 0
cpal-1.0; common public attribution; common public attribution licen[cs]e(?: version| v)?(?: 1 0)?; cpal 1 0; opensource org licenses cpal 1 0
ipl-1.0; ibm; ibm public licen[cs]e(?: version| v)?(?: 1 0)?; ipl 1 0; opensource org licenses ipl 1 0
artistic-1.0; artistic; artistic licen[cs]e(?: version| v)? 1 0; artistic 1 0; opensource org licenses artistic license 1 0
artistic-2.0; artistic; artistic licen[cs]e(?: version| v)? 2(?: 0)?; artistic 2 0; opensource org licenses artistic license 2 0
artistic; artistic; artistic licen[cs]e; artistic; perlfoundation org artistic license
psf-2.0; python; python software foundation licen[cs]e(?: version| v)?(?: 2(?: 0)?)?; psf 2 0; docs python org 3 license
php-3.01; php; php licen[cs]e(?: version| v)?(?: 3 0?1)?; php 3 01; php net license 3 01
ruby; ruby; ruby licen[cs]e; ruby; ruby lang org en about license
ofl-1.1; open font; sil open font licen[cs]e(?: version| v)?(?: 1 1)?; ofl 1 1;
eupl-1.1; european union; european union public licen[cs]e(?: version| v)? 1 1; eupl 1 1;
eupl-1.2; european union; european union public licen[cs]e(?: version| v)?(?: 1 2)?; eupl 1 2;
ms-pl; microsoft; microsoft public licen[cs]e; ms pl; opensource org licenses ms pl
ms-rl; microsoft; microsoft reciprocal licen[cs]e; ms rl; opensource org licenses ms rl
osl-3.0; open software; open software licen[cs]e(?: version| v)?(?: 3 0)?; osl 3 0; opensource org licenses osl 3 0
afl-3.0; academic free; academic free licen[cs]e(?: version| v)?(?: 3 0)?; afl 3 0; opensource org licenses afl 3 0
ecl-2.0; educational community; educational community licen[cs]e(?: version| v)?(?: 2(?: 0)?)?; ecl 2 0; opensource org licenses ecl 2 0
ncsa; ncsa; (?:university of illinois )?ncsa open source licen[cs]e; ncsa; opensource org licenses ncsa
postgresql; postgresql; postgresql licen[cs]e; postgresql; opensource org licenses postgresql
openssl; openssl; openssl licen[cs]e; openssl; openssl org source license
w3c; w3c; w3c software (?:notice and )?licen[cs]e; w3c;
x11; x11; x11 licen[cs]e; x11; spdx org licenses x11
sleepycat; sleepycat; sleepycat licen[cs]e; sleepycat; opensource org licenses sleepycat
vim; vim; vim licen[cs]e; vim;
beerware; beer; beerware licen[cs]e|beer ware licen[cs]e; beerware;
odbl-1.0; database; open database licen[cs]e(?: version| v)?(?: 1 0)?; odbl 1 0; opendatacommons org licenses odbl
odc-by-1.0; open data commons; open data commons attribution licen[cs]e(?: version| v)?(?: 1 0)?; odc by 1 0; opendatacommons org licenses by
pddl-1.0; open data commons; open data commons public domain dedication(?: and licen[cs]e)?; pddl 1 0; opendatacommons org licenses pddl
elastic-2.0; elastic; elastic licen[cs]e(?: version| v)?(?: 2(?: 0)?)?; elastic 2 0; elastic co licensing elastic license
sspl-1.0; server side; server side public licen[cs]e(?: version| v)?(?: 1)?; sspl 1 0; mongodb com licensing server side public license
busl-1.1; business source; business source licen[cs]e(?: version| v)?(?: 1 1)?; busl 1 1;
openrail; rail; (?:creativeml |bigscience )?(?:bloom )?(?:rail|openrail)(?: m)? licen[cs]e; openrail; huggingface co spaces bigscience license
"""

#: Creative Commons: rights and versions, from which the names follow.
CC_RIGHTS = {
    "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s",
    "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s", "by-nc": "attribution non ?commercial", "by": "attribution",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Well-known sentences of licence texts and notices, as words; label; keyword; pattern.
TEXTS = """
mit; above copyright; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit; including without; including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies
mit; as is; the software is provided as is without warranty of any kind express or implied
mit; event shall; in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit; license text; (?:see|read) the (?:file )?license text of the mit licen[cs]e
x11; except as; except as contained in this notice the name of .{1,80}? shall not be used in advertising or otherwise to promote
isc; provided that; provided that the above copyright notice and this permission notice appear in all copies
isc; disclaims all; the author disclaims all warranties with regard to this software
bsd; redistributions of; redistributions of source code must retain the above copyright notice
bsd; redistributions in; redistributions in binary form must reproduce the above copyright notice
bsd; copyright holders; this software is provided by the copyright holders and contributors as is
bsd; disclaimed in; implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event
bsd-4; this product; this product includes software developed by .{1,80}? advertising
bsd-3; specific prior; without specific prior written permission
bsd-2; views and; the views and conclusions contained in the software and documentation .{1,120}? representing official policies .{1,60}? reserved
zlib; must not; the origin of this software must not be misrepresented .{1,200}? permission
zlib; altered source; altered source versions must be plainly marked as such and must not be misrepresented as being the original source code
zlib; granted to; permission is granted to anyone to use this software for any purpose including commercial applications
libpng; this copy; this copy of the libpng notices is provided for your convenience .{1,80}? copyright
boost-1.0; machine executable; unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor .{0,40}?permission
boost-1.0; reproduce display; to use reproduce display distribute execute and transmit the software .{1,120}? permission
unlicense; anyone is; anyone is free to copy modify publish use compile sell or distribute this software .{1,60}? source code
unlicense; make this dedication; we make this dedication .{1,160}? relinquish(?:ment)? in perpetuity .{1,60}? copyright
wtfpl; want to; you just do what the fuck you want to .{0,40}?terms
gpl; free software foundation; under the terms of the gnu general public licen[cs]e as published by the free software foundation
gpl; later version; either version [1-3] of the licen[cs]e or at your option any later version
gpl; received a; you should have received a copy of the gnu general public licen[cs]e along with this (?:program|library|package)
gpl; gplv; gplv[23](?: or later)? licen[cs]ed?
gpl; merchantability or; without even the implied warranty of merchantability or fitness for a particular purpose
gpl; copyleft; this is a copyleft licen[cs]e
lgpl; lesser general; under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation
lgpl; library general; under the terms of the gnu library general public licen[cs]e
lgpl; received a; you should have received a copy of the gnu lesser general public licen[cs]e
lgpl; link; link(?:ing)? (?:statically or dynamically )?with other modules is .{1,60}? licen[cs]e
agpl; affero; you should have received a copy of the gnu affero general public licen[cs]e
agpl; computer network; remotely through a computer network .{1,80}? (?:public licen[cs]e|source code)
gpl-exception; special exception; as a special exception .{1,40}? permission to link
gpl-exception; classpath; classpath exception .{0,60}?licen[cs]e
gpl-exception; runtime library; gcc runtime library exception .{0,40}?(?:licen[cs]e|terms|permission)
gfdl; invariant; permission is granted to copy distribute and or modify this document .{1,160}? with no invariant sections
gfdl; free documentation; under the terms of the gnu free documentation licen[cs]e
apache-2.0; under the apache; licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e
apache-2.0; obtain a; you may obtain a copy of the licen[cs]e at
apache-2.0; unless required; unless required by applicable law or agreed to in writing software distributed under the licen[cs]e
apache-2.0; limitations under; see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e
apache-2.0; contributor license; licen[cs]ed to the apache software foundation asf under one or more contributor license agreements
apache-1.1; end user; the end user documentation included with the redistribution
mpl-1.1; initial developer; the initial developer of the original code is .{1,120}? reserved
mpl-1.1; express or; software distributed under the licen[cs]e is distributed on an as is basis without warranty of any kind either express or implied
mpl-2.0; incompatible with; this source code form is incompatible with secondary licenses
epl; eclipse public; made available under the terms of the eclipse public licen[cs]e
epl; secondary; this source code may also be made available under the following secondary licenses
cddl-1.0; development and; subject to the terms of the common development and distribution licen[cs]e
cddl-1.0; cddl header; cddl header start .{0,80}?terms
cpl-1.0; common public; made available under the terms of the common public licen[cs]e
artistic-2.0; verbatim copies; everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document
artistic; otherwise modify; you may otherwise modify your copy of this package .{1,120}? public domain
psf-2.0; psf hereby; subject to the terms and conditions of this licen[cs]e agreement psf hereby grants
php-3.01; products derived; products derived from this software may not be called php .{0,80}?permission
ruby; you may; you may make and give away verbatim copies of the source form of the software
postgresql; without a written; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
ncsa; university of; neither the names of .{1,100}? university of illinois .{1,140}? may be used to endorse
openssl; openssl project; this product includes software developed by the openssl project .{0,120}?(?:advertising|licen[cs]e|permission)
curl; curl; permission to use copy modify and distribute this software .{1,60}? curl
ofl-1.1; font software; this font software is licen[cs]ed under the sil open font licen[cs]e
ofl-1.1; reserved font; with reserved font names?
ofl-1.1; may not; the font software .{1,80}? may not be sold by itself .{0,40}?licen[cs]e
cc; creative commons; this (?:work|document|page|text|article) is licen[cs]ed under a creative commons
cc; creative commons; except where otherwise noted .{1,80}? creative commons
cc; some rights; some rights reserved .{0,40}?creative commons
cc-by; appropriate credit; you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made
cc-by-sa; your contributions; you must distribute your contributions under the same licen[cs]e as the original
cc-by-nc; commercial purposes; you may not use the material for commercial purposes
cc-by-nd; remix; if you remix transform or build upon the material you may not distribute the modified material .{0,60}?(?:licen[cs]e|terms)
cc0-1.0; this deed; the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0; extent; to the extent possible under law .{1,80}? waived all copyright
public-domain; no copyright; (?:there is )?no copyright (?:is )?(?:claimed|intended)
public-domain; united states; work of the united states government .{1,80}? (?:public domain|copyright)
eupl-1.2; under the eupl; licen[cs]ed under the eupl
elastic-2.0; managed service; you may not provide the software to third parties as a hosted or managed service .{0,80}?(?:licen[cs]e|terms)
sspl-1.0; service source; if you make the functionality of the program .{1,80}? service source code
busl-1.1; production use; the licensor hereby grants you the right .{1,120}? (?:non )?production use
openrail; use based; you shall not use the model .{1,40}? use based restrictions .{0,40}?(?:licen[cs]e|terms)
commons-clause; commons clause; commons clause .{0,40}?licen[cs]e
polyform; polyform; polyform (?:noncommercial|small business|shield|strict|free trial|internal use) licen[cs]e
json; good not; the software shall be used for good not evil .{0,40}?(?:licen[cs]e|permission)
bsd-source-code; source code; redistributions of source code must retain the copyright notices? as they appear
fsf-all-permissive; medium; copying and distribution of this file with or without modification are permitted in any medium without royalty .{0,80}?copyright
proprietary; proprietary information|proprietary trade|trade secret; contains? (?:confidential and )?proprietary (?:information|trade secrets?)
proprietary; unauthorized; unauthorized (?:copying|use|reproduction|distribution) .{1,80}? (?:strictly )?prohibited .{0,60}?(?:copyright|permission|proprietary)
proprietary; not for; not for public (?:re)?distribution
proprietary; internal use; for internal use only .{0,60}?(?:proprietary|reserved|copyright)
proprietary; reproduced; no part of this (?:publication|book|document|work) may be reproduced .{1,200}? permission
proprietary; reproduction; reproduction (?:in whole or in part )?(?:without|requires) (?:written )?permission
reserved; trademarks|patents|other rights; all (?:trademarks|patents|other rights) .{0,60}?reserved
copyright; copyright; copyright (?:by|of|owner|holder|notice)
copyright; copyright; (?:protected by|subject to|under) (?:international )?copyright(?: laws?| treaties)?
copyright; copyright; for copyright (?:information|details|questions)
terms-of-use; terms; by (?:using|accessing|downloading) .{1,60}? you (?:agree|accept) .{1,40}? terms
terms-of-use; terms and; (?:general |our |the )?terms and conditions (?:apply|of (?:use|service|sale))
eula; license agreement; (?:software |user )?license agreement
trial; evaluation; for evaluation (?:purposes|use) only .{0,60}?licen[cs]e
donationware; donat; licen[cs]e .{0,60}?donat(?:e|ion)
dual; dual licen; dual licen[cs]ed? (?:under|as|with)
multi; your choice|your option; at your (?:choice|option) .{1,60}? licen[cs]es?
mit; permission is; permission is hereby granted free of charge to any person obtaining a copy
isc; permission to; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd; redistribution and|redistributions and; redistributions? and use in source and binary forms with or without modification(?: are permitted)?
bsd-3; endorse; neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote
bsd-4; advertising; all advertising materials mentioning features or use of this software must display
zlib; implied warranty; this software is provided as is without any express or implied warranty
boost-1.0; permission is; permission is hereby granted free of charge to any person or organization obtaining a copy
unlicense; free and unencumbered; this is free and unencumbered software released into the public domain
gpl; free software; this (?:program|library|file) is free software you can redistribute it and or modify
gpl; without any warranty; distributed in the hope that it will be useful but without any warranty
apache-2.0; compliance; you may not use this file except in compliance with the licen[cs]e
mpl-2.0; source code form; this source code form is subject to the terms of the mozilla public licen[cs]e
epl; accompanying materials; this program and the accompanying materials are made available under the terms
wtfpl; everyone is permitted; everyone is permitted to copy and distribute verbatim or modified copies
public-domain; public domain; (?:released|placed|dedicated|is) (?:in ?to|to|in) the public domain
public-domain; public domain; public domain(?: dedication| mark)?
reserved; rights reserved; (?:all|some|no) rights reserved
copyright; copyright; copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?
copyright; copyright; copyrighted (?:material|work|by)
proprietary; proprietary; (?:proprietary and confidential|confidential and proprietary|proprietary licen[cs]e|proprietary software)
proprietary; written permission; without (?:the )?(?:express |prior )*written permission
commercial; commercial; commercial licen[cs]e
non-commercial; commercial; for (?:personal and )?non ?commercial (?:use|purposes)(?: only)?
research-only; research; for (?:academic |scientific )?research (?:use|purposes) only
eula; end user; end user licen[cs]e agreement
terms-of-use; terms of; (?:subject to|see|by) (?:the|our|these) terms of (?:use|service)
"""
TEXT_PRIORITY = {"copyright": 6, "commercial": 6, "public-domain": 5, "reserved": 5, "terms-of-use": 6, "dual": 6, "multi": 6, "trial": 6, "donationware": 6, "eula": 5, "proprietary": 3}


def signature_rules() -> list[SignatureRule]:
    """All rules: tag (1), text (2), page (3), grant (4) and mention (5) of each licence, notices last."""
    named = [[c.strip() for c in line.split(";")] for line in NAMES.strip().splitlines()]
    for rights, words in CC_RIGHTS.items():
        spaced = rights.replace("-", " ")
        for v in ("", *CC_VERSIONS):
            number = (" " + v.replace(".", " ")) if v else ""
            named.append([
                f"cc-{rights}" + (f"-{v}" if v else ""), f"cc {spaced}", f"cc {spaced}(?: licen[cs]e)?{number}", f"cc {spaced}{number}",
                f"creativecommons org licenses {spaced}{number}"])
            named.append([f"cc-{rights}" + (f"-{v}" if v else ""), "creative commons", f"creative commons {words}(?: licen[cs]e)?(?: international| unported)?{number}", "", ""])
    out = []
    for label, keyword, name, short, page in named:
        if short:
            out.append(SignatureRule(label, 1, f"identifier {short}", f"spdx licen[cs]e identifier {short}(?: only| or later)?"))
            out.append(SignatureRule(label, 4, short, f"licen[cs]ed under(?: the)?(?: terms of the)? {short}"))
        if page:
            out.append(SignatureRule(label, 3, page.split(" (")[0], page))
        out.append(SignatureRule(label, 4, keyword, f"(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? (?:{name})(?: only| or(?: any)? later(?: version)?)?"))
        out.append(SignatureRule(label, 5, keyword, f"(?:{name})(?: only| or(?: any)? later(?: version)?)?"))
    for line in TEXTS.strip().splitlines():
        label, keyword, pattern = (c.strip() for c in line.split(";"))
        out.append(SignatureRule(label, TEXT_PRIORITY.get(label, 2), keyword, pattern))
    return out
