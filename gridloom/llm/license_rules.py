"""Ordered license signature rules: hand-written regular expressions with a keyword each.

Every rule has a label, a tier (0: the words of a notice; 1: a grant "under the ..."; 2: a
name alone), a pattern for text whose A-Z are lower case, and a keyword, the longest plain part that each of its
matches contains. FAMILIES holds a line per license: label | SPDX ids | name patterns, separated by ;; and
NOTICES the sentences of license texts: label | patterns. Patterns use no anchors, no captures and no look-around,
so that Java and RE2 read them alike; a match must begin and end at word edges, which the scan checks.
"""

from __future__ import annotations

FAMILIES = r"""
mit | mit | mit[- ]licen[cs]e;;mit/x11 licen[cs]e;;x11 licen[cs]e \(mit\)
mit-0 | mit-0 | mit no attribution( licen[cs]e)?;;mit-0 licen[cs]e
x11 | x11 | x11 licen[cs]e;;x consortium licen[cs]e
expat | expat | expat licen[cs]e
apache-2 | apache-2.0 | apache licen[cs]e,? (version )?2(\.0)?;;apache software licen[cs]e,? (version )?2(\.0)?;;apache[- ]2(\.0)? licen[cs]e;;asl,? v?2\.0
apache-1.1 | apache-1.1 | apache (software )?licen[cs]e,? (version )?1\.1
apache-1 | apache-1.0 | apache (software )?licen[cs]e,? (version )?1\.0
bsd-2-clause | bsd-2-clause | (bsd )?(2|two)[- ]clause bsd( licen[cs]e)?;;bsd (2|two)[- ]clause( licen[cs]e)?;;simplified bsd licen[cs]e;;freebsd licen[cs]e
bsd-3-clause | bsd-3-clause | (bsd )?(3|three)[- ]clause bsd( licen[cs]e)?;;bsd (3|three)[- ]clause( licen[cs]e)?;;(new|modified|revised) bsd licen[cs]e
bsd-4-clause | bsd-4-clause | (4|four)[- ]clause bsd( licen[cs]e)?;;bsd (4|four)[- ]clause( licen[cs]e)?;;original bsd licen[cs]e
0bsd | 0bsd | (zero|0)[- ]clause bsd( licen[cs]e)?;;bsd zero clause( licen[cs]e)?
bsd | bsd | bsd[- ](style )?licen[cs]e;;berkeley software distribution licen[cs]e
isc | isc | isc licen[cs]e;;internet systems consortium licen[cs]e
gpl-1 | gpl-1.0;gpl-1.0-only;gpl-1.0-or-later | gnu general public licen[cs]e,? (version |v)?1(\.0)?;;gnu gpl,? ?(version |v)?1(\.0)?;;gpl ?v1
gpl-2 | gpl-2.0;gpl-2.0-only;gpl-2.0-or-later;gpl-2.0+ | gnu general public licen[cs]e,? (version |v)?2(\.0)?;;gnu gpl,? ?(version |v)?2(\.0)?;;gpl[- ]?v?2(\.0)?
gpl-3 | gpl-3.0;gpl-3.0-only;gpl-3.0-or-later;gpl-3.0+ | gnu general public licen[cs]e,? (version |v)?3(\.0)?;;gnu gpl,? ?(version |v)?3(\.0)?;;gpl[- ]?v?3(\.0)?
gpl | gpl | gnu general public licen[cs]e;;gnu gpl;;general public licen[cs]e
lgpl-2 | lgpl-2.0;lgpl-2.0-only;lgpl-2.0-or-later | gnu library general public licen[cs]e,? (version |v)?2(\.0)?;;lgpl[- ]?v?2\.0
lgpl-2.1 | lgpl-2.1;lgpl-2.1-only;lgpl-2.1-or-later;lgpl-2.1+ | gnu lesser general public licen[cs]e,? (version |v)?2\.1;;gnu lgpl,? ?(version |v)?2\.1;;lgpl[- ]?v?2\.1
lgpl-3 | lgpl-3.0;lgpl-3.0-only;lgpl-3.0-or-later;lgpl-3.0+ | gnu lesser general public licen[cs]e,? (version |v)?3(\.0)?;;gnu lgpl,? ?(version |v)?3(\.0)?;;lgpl[- ]?v?3(\.0)?
lgpl | lgpl | gnu (lesser|library) general public licen[cs]e;;gnu lgpl;;lgpl licen[cs]e
agpl-3 | agpl-3.0;agpl-3.0-only;agpl-3.0-or-later | gnu affero general public licen[cs]e(,? (version |v)?3(\.0)?)?;;gnu agpl(,? ?(version |v)?3(\.0)?)?;;agpl[- ]?v?3(\.0)?;;affero gpl
agpl-1 | agpl-1.0;agpl-1.0-only | affero general public licen[cs]e,? (version |v)?1(\.0)?
gfdl-1.2 | gfdl-1.2;gfdl-1.2-only;gfdl-1.2-or-later | gnu free documentation licen[cs]e,? (version |v)?1\.2;;gfdl[- ]?v?1\.2
gfdl-1.3 | gfdl-1.3;gfdl-1.3-only;gfdl-1.3-or-later | gnu free documentation licen[cs]e,? (version |v)?1\.3;;gfdl[- ]?v?1\.3
gfdl | gfdl | gnu free documentation licen[cs]e;;gnu fdl
mpl-1 | mpl-1.0 | mozilla public licen[cs]e,? (version |v)?1\.0;;mpl[- ]?v?1\.0
mpl-1.1 | mpl-1.1 | mozilla public licen[cs]e,? (version |v)?1\.1;;mpl[- ]?v?1\.1
mpl-2 | mpl-2.0;mpl-2.0-no-copyleft-exception | mozilla public licen[cs]e,? (version |v)?2(\.0)?;;mpl[- ]?v?2(\.0)?
epl-1 | epl-1.0 | eclipse public licen[cs]e,? ?-? ?(version |v)?1\.0;;epl[- ]?v?1\.0
epl-2 | epl-2.0 | eclipse public licen[cs]e,? ?-? ?(version |v)?2\.0;;epl[- ]?v?2\.0
edl-1 | edl-1.0 | eclipse distribution licen[cs]e,? ?-? ?(version |v)?1\.0
eupl-1.1 | eupl-1.1 | european union public licen[cs]e,? (version |v)?\.? ?1\.1;;eupl[- ]?v?1\.1
eupl-1.2 | eupl-1.2 | european union public licen[cs]e,? (version |v)?\.? ?1\.2;;eupl[- ]?v?1\.2
cddl-1 | cddl-1.0 | common development and distribution licen[cs]e(,? (version |v)?1\.0)?;;cddl[- ]?v?1\.0
cddl-1.1 | cddl-1.1 | common development and distribution licen[cs]e,? (version |v)?1\.1;;cddl[- ]?v?1\.1
cpl-1 | cpl-1.0 | common public licen[cs]e(,? (version |v)?1\.0)?
cpal-1 | cpal-1.0 | common public attribution licen[cs]e(,? (version |v)?1\.0)?
ipl-1 | ipl-1.0 | ibm public licen[cs]e(,? (version |v)?1\.0)?
apsl-2 | apsl-2.0 | apple public source licen[cs]e(,? (version |v)?2(\.0)?)?
ms-pl | ms-pl | microsoft public licen[cs]e;;ms-pl licen[cs]e
ms-rl | ms-rl | microsoft reciprocal licen[cs]e;;ms-rl licen[cs]e
ms-lpl | ms-lpl | microsoft limited public licen[cs]e
osl-3 | osl-3.0 | open software licen[cs]e,? (version |v)?\.? ?3\.0;;osl[- ]?v?3\.0
osl-2.1 | osl-2.1 | open software licen[cs]e,? (version |v)?\.? ?2\.1;;osl[- ]?v?2\.1
afl-3 | afl-3.0 | academic free licen[cs]e,? (version |v)?\.? ?3\.0;;afl[- ]?v?3\.0
afl-2.1 | afl-2.1 | academic free licen[cs]e,? (version |v)?\.? ?2\.1;;afl[- ]?v?2\.1
artistic-1 | artistic-1.0;artistic-1.0-perl | artistic licen[cs]e,? (version |v)?1\.0;;perl artistic licen[cs]e
artistic-2 | artistic-2.0 | artistic licen[cs]e,? (version |v)?2(\.0)?
artistic | artistic | the artistic licen[cs]e;;clarified artistic licen[cs]e
bsl-1 | bsl-1.0 | boost software licen[cs]e(,? ?-? ?(version |v)?1\.0)?
busl-1.1 | busl-1.1 | business source licen[cs]e(,? (version |v)?1\.1)?;;busl[- ]?v?1\.1
zlib | zlib | zlib licen[cs]e;;zlib/libpng licen[cs]e
libpng | libpng;libpng-2.0 | libpng licen[cs]e;;png reference library licen[cs]e
unlicense | unlicense | the unlicen[cs]e;;unlicen[cs]e licen[cs]e
wtfpl | wtfpl | wtfpl;;do what the f[*u][*c]k you want to public licen[cs]e
cc0-1 | cc0-1.0 | cc0( 1\.0)?( universal)?;;cc0 public domain dedication
cc-by-1 | cc-by-1.0 | creative commons attribution 1\.0;;cc[- ]by[- ]1\.0
cc-by-2 | cc-by-2.0 | creative commons attribution 2\.0;;cc[- ]by[- ]2\.0
cc-by-2.5 | cc-by-2.5 | creative commons attribution 2\.5;;cc[- ]by[- ]2\.5
cc-by-3 | cc-by-3.0 | creative commons attribution 3\.0( unported)?;;cc[- ]by[- ]3\.0
cc-by-4 | cc-by-4.0 | creative commons attribution 4\.0( international)?;;cc[- ]by[- ]4\.0
cc-by-sa-2 | cc-by-sa-2.0 | creative commons attribution[- ]share ?alike 2\.0;;cc[- ]by[- ]sa[- ]2\.0
cc-by-sa-3 | cc-by-sa-3.0 | creative commons attribution[- ]share ?alike 3\.0( unported)?;;cc[- ]by[- ]sa[- ]3\.0
cc-by-sa-4 | cc-by-sa-4.0 | creative commons attribution[- ]share ?alike 4\.0( international)?;;cc[- ]by[- ]sa[- ]4\.0
cc-by-nd-3 | cc-by-nd-3.0 | creative commons attribution[- ]no ?deriv(ative)?s? 3\.0;;cc[- ]by[- ]nd[- ]3\.0
cc-by-nd-4 | cc-by-nd-4.0 | creative commons attribution[- ]no ?deriv(ative)?s? 4\.0;;cc[- ]by[- ]nd[- ]4\.0
cc-by-nc-3 | cc-by-nc-3.0 | creative commons attribution[- ]non ?commercial 3\.0;;cc[- ]by[- ]nc[- ]3\.0
cc-by-nc-4 | cc-by-nc-4.0 | creative commons attribution[- ]non ?commercial 4\.0;;cc[- ]by[- ]nc[- ]4\.0
cc-by-nc-sa-3 | cc-by-nc-sa-3.0 | creative commons attribution[- ]non ?commercial[- ]share ?alike 3\.0;;cc[- ]by[- ]nc[- ]sa[- ]3\.0
cc-by-nc-sa-4 | cc-by-nc-sa-4.0 | creative commons attribution[- ]non ?commercial[- ]share ?alike 4\.0;;cc[- ]by[- ]nc[- ]sa[- ]4\.0
cc-by-nc-nd-3 | cc-by-nc-nd-3.0 | creative commons attribution[- ]non ?commercial[- ]no ?deriv(ative)?s? 3\.0;;cc[- ]by[- ]nc[- ]nd[- ]3\.0
cc-by-nc-nd-4 | cc-by-nc-nd-4.0 | creative commons attribution[- ]non ?commercial[- ]no ?deriv(ative)?s? 4\.0;;cc[- ]by[- ]nc[- ]nd[- ]4\.0
cc-by-nc | cc-by-nc | creative commons attribution[- ]non ?commercial;;cc[- ]by[- ]nc
cc-by-sa | cc-by-sa | creative commons attribution[- ]share ?alike;;cc[- ]by[- ]sa
cc-by-nd | cc-by-nd | creative commons attribution[- ]no ?deriv(ative)?s?;;cc[- ]by[- ]nd
cc-by-nc-sa | cc-by-nc-sa | creative commons attribution[- ]non ?commercial[- ]share ?alike;;cc[- ]by[- ]nc[- ]sa
cc-by-nc-nd | cc-by-nc-nd | creative commons attribution[- ]non ?commercial[- ]no ?deriv(ative)?s?;;cc[- ]by[- ]nc[- ]nd
cc-by | cc-by | creative commons attribution( licen[cs]e)?;;cc[- ]by licen[cs]e
cc-pd | cc-pddc | creative commons public domain( mark| dedication)?;;public domain mark 1\.0
pddl-1 | pddl-1.0 | (open data commons )?public domain dedication (and|&) licen[cs]e
odbl-1 | odbl-1.0 | open database licen[cs]e;;odbl[- ]?v?1\.0
odc-by-1 | odc-by-1.0 | open data commons attribution licen[cs]e
ogl-uk-3 | ogl-uk-3.0 | open government licen[cs]e(,? (version |v)?3(\.0)?)?
ofl-1.1 | ofl-1.1;ofl-1.1-rfn | sil open font licen[cs]e(,? (version |v)?1\.1)?;;ofl[- ]?v?1\.1
ofl-1 | ofl-1.0 | sil open font licen[cs]e,? (version |v)?1\.0
psf-2 | psf-2.0 | psf licen[cs]e agreement for python;;python software foundation licen[cs]e(,? (version |v)?2)?
python-2 | python-2.0 | python licen[cs]e 2\.0;;cnri python licen[cs]e
ruby | ruby | ruby licen[cs]e;;ruby'?s licen[cs]e
php-3 | php-3.0;php-3.01 | php licen[cs]e(,? (version |v)?3\.0?1?)?
perl | perl | same terms as perl( itself)?
openssl | openssl | openssl licen[cs]e;;openssl/ssleay licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
ncsa | ncsa | university of illinois/ncsa open source licen[cs]e;;ncsa open source licen[cs]e
upl-1 | upl-1.0 | universal permissive licen[cs]e(,? (version |v)?1\.0)?;;upl[- ]?v?1\.0
vim | vim | vim licen[cs]e
w3c | w3c | w3c software( notice and)? licen[cs]e;;w3c document licen[cs]e
zpl-2.1 | zpl-2.1;zpl-2.0 | zope public licen[cs]e(,? (version |v)?2\.[01])?
qpl-1 | qpl-1.0 | q public licen[cs]e(,? (version |v)?1\.0)?
sleepycat | sleepycat | sleepycat licen[cs]e
sspl-1 | sspl-1.0 | server side public licen[cs]e(,? (version |v)?1)?;;sspl[- ]?v?1
elastic-2 | elastic-2.0 | elastic licen[cs]e(,? (version |v)?2(\.0)?)?
polyform-nc-1 | polyform-noncommercial-1.0.0 | polyform noncommercial licen[cs]e( 1\.0\.0)?
polyform-sb-1 | polyform-small-business-1.0.0 | polyform small business licen[cs]e( 1\.0\.0)?
blueoak-1 | blueoak-1.0.0 | blue oak model licen[cs]e( 1\.0\.0)?
bigscience-rail-1 | bigscience-bloom-rail-1.0 | bigscience (bloom )?rail licen[cs]e( v?1\.0)?
openrail-m | openrail;openrail-m | open ?rail(-|\+\+)?m? licen[cs]e
cecill-2.1 | cecill-2.0;cecill-2.1 | cecill (free software )?licen[cs]e( agreement)?(,? (version |v)?2(\.[01])?)?
cecill-b | cecill-b | cecill-b( free software)? licen[cs]e
cecill-c | cecill-c | cecill-c( free software)? licen[cs]e
mulan-2 | mulanpsl-2.0;mulanpsl-1.0 | mulan (permissive software|psl) licen[cs]e(,? (version |v)?[12])?
ecl-2 | ecl-2.0 | educational community licen[cs]e(,? (version |v)?2\.0)?
eiffel-2 | efl-2.0 | eiffel forum licen[cs]e(,? (version |v)?2)?
hpnd | hpnd | historical permission notice and disclaimer
intel | intel | intel open source licen[cs]e;;intel simplified software licen[cs]e
jam | jam | jam/mr licen[cs]e
json | json | the json licen[cs]e
lppl-1.3 | lppl-1.3a;lppl-1.3c | latex project public licen[cs]e(,? (version |v)?1\.3[ac]?)?
naist | naist-2003 | nara institute of science and technology licen[cs]e
nasa-1.3 | nasa-1.3 | nasa open source agreement( version)? 1\.3
ntp | ntp | ntp licen[cs]e
oldap-2.8 | oldap-2.8 | openldap public licen[cs]e(,? (version |v)?2\.8)?
rpl-1.5 | rpl-1.5;rpl-1.1 | reciprocal public licen[cs]e(,? (version |v)?1\.[15])?
sgi-b-2 | sgi-b-2.0 | sgi free software licen[cs]e b(,? (version |v)?2\.0)?
simpl-2 | simpl-2.0 | simple public licen[cs]e(,? (version |v)?2\.0)?
sissl | sissl | sun industry standards source licen[cs]e
spl-1 | spl-1.0 | sun public licen[cs]e(,? (version |v)?1\.0)?
tcl | tcl | tcl/tk licen[cs]e
unicode | unicode-dfs-2016;unicode-3.0 | unicode (inc\. )?licen[cs]e agreement;;unicode licen[cs]e v3
watcom-1 | watcom-1.0 | sybase open watcom public licen[cs]e(,? (version |v)?1\.0)?
xnet | xnet | x\.net licen[cs]e
beerware | beerware | beer-?ware licen[cs]e
llama | llama2;llama3 | llama [23](\.[0-9])? community licen[cs]e( agreement)?
gemma | gemma | gemma terms of use
proprietary | proprietary | proprietary licen[cs]e;;commercial licen[cs]e agreement
"""

NOTICES = r"""
mit | permission is hereby granted, free of charge, to any person obtaining a copy
mit | the above copyright notice and this permission notice (\(including the next paragraph\) )?shall be included in all copies or substantial portions
apache-2 | licensed under the apache licen[cs]e, version 2\.0
apache-2 | apache\.org/licenses/license-2\.0
bsd-2-clause | redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-3-clause | neither the names? of .{1,80} may be used to endorse or promote products
bsd-4-clause | all advertising materials mentioning features or use of this software must display
isc | permission to use, copy, modify,? (and/or|and) distribute this software for any purpose with or without fee is hereby granted
gpl | this program is free software[:;] you can redistribute it and/or modify it under the terms
gpl-2 | gnu\.org/licenses/(old-licenses/)?gpl-2\.0
gpl-3 | gnu\.org/licenses/gpl-3\.0
lgpl | this library is free software[:;] you can redistribute it and/or modify it under the terms
lgpl-2.1 | gnu\.org/licenses/(old-licenses/)?lgpl-2\.1
lgpl-3 | gnu\.org/licenses/lgpl-3\.0
agpl-3 | gnu\.org/licenses/agpl-3\.0
gfdl | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation
mpl-2 | this source code form is subject to the terms of the mozilla public licen[cs]e, v\. 2\.0
mpl-2 | mozilla\.org/mpl/2\.0
mpl-1.1 | mozilla\.org/mpl/mpl-1\.1
epl-2 | eclipse\.org/legal/epl-2\.0
epl-1 | eclipse\.org/legal/epl-v10
cc0-1 | creativecommons\.org/publicdomain/zero/1\.0
cc-pd | creativecommons\.org/publicdomain/mark/1\.0
cc-by-4 | creativecommons\.org/licenses/by/4\.0
cc-by-3 | creativecommons\.org/licenses/by/3\.0
cc-by-2 | creativecommons\.org/licenses/by/2\.0
cc-by-sa-4 | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-sa-4 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-4 | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nd-4 | creativecommons\.org/licenses/by-nd/4\.0
cc-by | creativecommons\.org/licenses/by/
mit | opensource\.org/licenses/mit
bsd-3-clause | opensource\.org/licenses/bsd-3-clause
bsd-2-clause | opensource\.org/licenses/bsd-2-clause
unlicense | this is free and unencumbered software released into the public domain
zlib | provided 'as-is', without any express or implied warranty
bsl-1 | boost\.org/license_1_0
ofl-1.1 | scripts\.sil\.org/ofl
wtfpl | you just do what the f[*u][*c]k you want to
psf-2 | copyright (\(c\) )?[0-9, -]+ python software foundation
odbl-1 | opendatacommons\.org/licenses/odbl
pddl-1 | opendatacommons\.org/licenses/pddl
ogl-uk-3 | nationalarchives\.gov\.uk/doc/open-government-licence/version/3
public-domain | (is|are|placed|released|dedicated)( hereby)?( in| into| to)? the public domain
all-rights-reserved | all rights reserved
no-commercial-use | not for commercial use;;for non-?commercial (use|purposes) only
proprietary | proprietary and confidential
proprietary | unauthori[sz]ed (copying|use|distribution) of this (file|software|document)
"""

GRANT = r"(licen[cs]ed|released|distributed|available|provided|published|shared|covered|made available) under (the )?(terms of (the )?|conditions of (the )?)?"


def keyword(pattern: str) -> str:
    """The longest run of plain characters that every match of the pattern contains."""
    runs, at, depth = [""], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[":
            at = pattern.index("]", at)
            runs.append("")
        elif c in "()":
            depth += 1 if c == "(" else -1
            runs.append("")
        elif c in "?*{":
            runs[-1] = runs[-1][:-1]
            runs.append("")
            at = pattern.index("}", at) if c == "{" else at
        elif c in ".+":
            runs.append("")
        else:
            if c == "\\":
                at += 1
                c = pattern[at]
            if not depth:
                runs[-1] += c
        at += 1
    return max(runs, key=len)


def _rules() -> list[dict]:
    """The rules in order of priority within their tier."""
    grants, names, notices = [], [], []
    for line in FAMILIES.strip().splitlines():
        label, _, patterns = (x.strip() for x in line.split(" | ", 2))
        for pattern in patterns.split(";;"):
            grants.append((label, 1, GRANT + pattern))
            names.append((label, 2, pattern))
    for line in NOTICES.strip().splitlines():
        label, patterns = (x.strip() for x in line.split(" | ", 1))
        notices += [(label, 0, p) for p in patterns.split(";;")]
    rules = notices + grants + names
    return [{"label": label, "tier": tier, "keyword": keyword(p.removeprefix(GRANT)), "pattern": p, "rank": k} for k, (label, tier, p) in enumerate(rules)]


RULES = _rules()

#: A license's identifier, and an expression of several: with "or", "and" and "with", in parentheses.
IDENTIFIER = r"[a-z0-9]([a-z0-9.+-]*[a-z0-9+])?"
_OPERAND = rf"(\( ?)*{IDENTIFIER}( ?\))*"
#: Where expressions stand, with what comes before them and a string that every match contains: after a tag, and after words of a grant that names several.
EXPRESSIONS = (
    ("spdx-license-identifier:", rf"spdx-license-identifier: ?{_OPERAND}( (and|or|with) {_OPERAND})*", "spdx-license-identifier: ?"),
    ("licen", rf"licen[cs]ed under (either )?(the )?{IDENTIFIER}( ?/ ?{IDENTIFIER}| (and|or) (the )?{IDENTIFIER})+", "licen[cs]ed under (either )?(the )?"),
)


def identifiers() -> dict[str, str]:
    """The label of each identifier; the versions of a family have one each, so an identifier is matched whole or not at all."""
    families = (line.split(" | ", 2) for line in FAMILIES.strip().splitlines())
    return {spdx: label.strip() for label, ids, _ in families for spdx in ids.strip().split(";")}
