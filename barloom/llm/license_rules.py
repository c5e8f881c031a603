"""Signatures of licenses, written by hand (fixed values).

One signature a line: label, a bar, and a regex over words in lower case with one space between them.
``licen[cs]e`` is spelled ``L`` and a version's dot is a space.  Sections run from the most telling to
the least; the section's place is the priority of its signatures.
"""

from __future__ import annotations

import re

#: Clauses of license texts and their usual notices.
CLAUSES = r"""
mit|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|to deal in the software without restriction including without limitation the rights to use copy modify merge publish
mit|the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit|fitness for a particular purpose and noninfringement
mit-0|permission is hereby granted free of charge to any person obtaining a copy of this software without restriction no attribution
mit-modern|permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
bsd|redistribution and use in source and binary forms with or without modification are permitted
bsd|redistributions of source code must retain the above copyright notice this list of conditions
bsd|redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-3-clause|neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause|the views and conclusions contained in the software and documentation are those of the authors
bsd|this software is provided by the (?:copyright holders|regents|authors?) and contributors as is
bsd|in no event shall the (?:copyright (?:holder|owner)|regents|authors?) or contributors be liable for any direct indirect incidental
0bsd|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
isc|the software is provided as is and the author disclaims all warranties with regard to this software
isc|in no event shall the author be liable for any special direct indirect or consequential damages
apache|you may not use this file except in compliance with the L
apache|you may obtain a copy of the L at (?:https? )?www apache org licenses L 2 0
apache|unless required by applicable law or agreed to in writing software distributed under the L is distributed on an as is basis
apache|licensed to the apache software foundation asf under one or more contributor L agreements
apache|see the L for the specific language governing permissions and limitations under the L
apache|grant of patent L subject to the terms and conditions of this L each contributor hereby grants
gpl|you can redistribute it and or modify it under the terms of the gnu general public L
gpl|you should have received a copy of the gnu general public L along with
gpl|either version \d of the L or at your option any later version
gpl|this program is distributed in the hope that it will be useful but without any warranty
gpl|without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public L
gpl|the gnu general public L is a free copyleft L for software and other kinds of works
gpl|you must cause the modified files to carry prominent notices stating that you changed the files
gpl-2 0|59 temple place suite 330 boston ma 02111 1307 usa
gpl-2 0|51 franklin street fifth floor boston ma 02110 1301
lgpl|you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public L
lgpl|you should have received a copy of the gnu (?:lesser|library) general public L along with
lgpl|this library is distributed in the hope that it will be useful but without any warranty
lgpl|this L the lesser general public L applies to some specially designated software packages
agpl|you can redistribute it and or modify it under the terms of the gnu affero general public L
agpl|you should have received a copy of the gnu affero general public L along with
agpl|your modified version must prominently offer all users interacting with it remotely through a computer network
fdl|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation L
fdl|with no invariant sections no front cover texts and no back cover texts
mpl|this source code form is subject to the terms of the mozilla public L v 2 0
mpl|the contents of this file are subject to the mozilla public L version 1 1
mpl|if a copy of the mpl was not distributed with this file you can obtain one at
epl|this program and the accompanying materials are made available under the terms of the eclipse public L
epl|all rights reserved this program and the accompanying materials are made available
cpl|this program and the accompanying materials are made available under the terms of the common public L
cddl|the contents of this file are subject to the terms of the common development and distribution L
cddl|when distributing covered code include this cddl header in each file
cddl|you can obtain a copy of the L at usr src opensolaris L
eupl|licensed under the eupl version 1 \d (?:only|or as soon they will be approved by the european commission)
zlib|this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib|the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib|altered source versions must be plainly marked as such and must not be misrepresented
artistic|the intent of this document is to state the conditions under which a package may be copied
artistic|everyone is permitted to copy and distribute verbatim copies of this L document but changing it is not allowed
boost|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost|distributed under the boost software L version 1 0
boost|see accompanying file L 1 0 txt or copy at
unlicense|this is free and unencumbered software released into the public domain
unlicense|anyone is free to copy modify publish use compile sell or distribute this software
wtfpl|everyone is permitted to copy and distribute verbatim or modified copies of this L document and changing it is allowed
wtfpl|you just do what the fuck you want to
ofl|this font software is licensed under the sil open font L
ofl|the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces
psf|this L agreement is between the python software foundation psf and the individual or organization
psf|psf is making python available to licensee on an as is basis
php|this product includes php software freely available from
php|products derived from this software may not be called php
ruby|you can redistribute it and or modify it under either the terms of the 2 clause bsdl
openssl|this product includes software developed by the openssl project for use in the openssl toolkit
openssl|this product includes cryptographic software written by eric young
postgresql|permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
ms-pl|if you use the software you accept this L if you do not accept the L do not use the software
ms-rl|for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code
osl|licensed under the open software L version
afl|licensed under the academic free L version
ecl|licensed under the educational community L version 2 0
lppl|this work may be distributed and or modified under the conditions of the latex project public L
lppl|this work has the lppl maintenance status
ncsa|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software
upl|to any person obtaining a copy of this software associated documentation and or data collectively the software
cc0|to the extent possible under law the (?:person|author) who associated cc0 with this work has waived all copyright
cc0|the person who associated a work with this deed has dedicated the work to the public domain
cc-by|this work is licensed under a creative commons attribution \d 0 (?:international|unported|generic) L
cc-by-sa|this work is licensed under (?:a|the) creative commons attribution share ?alike \d \d (?:international |unported |generic )?L
cc-by-nc|this work is licensed under (?:a|the) creative commons attribution non ?commercial \d \d (?:international |unported |generic )?L
cc-by-nd|this work is licensed under (?:a|the) creative commons attribution no ?derivatives \d \d (?:international |unported |generic )?L
cc-by-nc-sa|this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike \d \d (?:international |unported |generic )?L
cc-by-nc-nd|this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s \d \d (?:international |unported |generic )?L
odbl|made available under the open database L
odbl|any rights in individual contents of the database are licensed under the database contents L
bsl|change date change L additional use grant
bsl|the business source L (?:this document or the L )?is not an open source L
sspl|if you make the functionality of the program or a modified version available to third parties as a service
elastic|you may not provide the software to third parties as a hosted or managed service
public-domain|(?:released|placed|dedicated) (?:into|in|to) the public domain
public-domain|the author (?:hereby )?disclaims copyright to this source code
public-domain|this (?:work|file|code|software) is in the public domain
proprietary|unauthorized copying of this file via any medium is strictly prohibited
proprietary|proprietary and confidential
proprietary|(?:copying|reproduction|redistribution|disclosure) (?:of this (?:file|document|material) )?is strictly prohibited
proprietary|may not be reproduced (?:in any form )?without (?:the )?(?:prior )?written permission
proprietary|this software contains confidential and proprietary information of
proprietary|trade secrets? of the copyright (?:holder|owner)
"""

#: Identifiers in file headers and manifests.
IDENTIFIERS = r"""
mit|spdx L identifier mit
apache|spdx L identifier apache 2 0
gpl|spdx L identifier gpl [123] 0
lgpl|spdx L identifier lgpl [23] [01]
agpl|spdx L identifier agpl 3 0
bsd-2-clause|spdx L identifier bsd 2 clause
bsd-3-clause|spdx L identifier bsd 3 clause
bsd-4-clause|spdx L identifier bsd 4 clause
0bsd|spdx L identifier 0bsd
isc|spdx L identifier isc
mpl|spdx L identifier mpl [12] [01]
epl|spdx L identifier epl [12] 0
cddl|spdx L identifier cddl 1 [01]
eupl|spdx L identifier eupl 1 [012]
zlib|spdx L identifier zlib
artistic|spdx L identifier artistic [12] 0
boost|spdx L identifier bsl 1 0
unlicense|spdx L identifier unlicense
wtfpl|spdx L identifier wtfpl
ofl|spdx L identifier ofl 1 [01]
cc0|spdx L identifier cc0 1 0
cc-by|spdx L identifier cc by \d \d
cc-by-sa|spdx L identifier cc by sa \d \d
cc-by-nc|spdx L identifier cc by nc \d \d
psf|spdx L identifier (?:psf|python) 2 0
postgresql|spdx L identifier postgresql
ms-pl|spdx L identifier ms pl
ms-rl|spdx L identifier ms rl
osl|spdx L identifier osl 3 0
afl|spdx L identifier afl [123] [012]
ecl|spdx L identifier ecl [12] 0
bsl|spdx L identifier busl 1 1
sspl|spdx L identifier sspl 1 0
elastic|spdx L identifier elastic 2 0
upl|spdx L identifier upl 1 0
apache|L apache 2 0
mit|L mit
gpl|L gplv2
gpl|L gplv3
gpl|module L gpl
gpl|L gpl
lgpl|L lgpl
bsd|module L dual bsd gpl
bsd|L bsd
isc|L isc
mpl|L mpl 2 0
"""

#: Names with a version.
VERSIONED = r"""
apache|apache (?:software )?L (?:version |v)?2 0
apache|apache (?:software )?L (?:version |v)?2
apache|apache (?:software )?L (?:version |v)?1 [01]
apache|apache v?2 0
apache|asl (?:version |v)?[12] [01]
gpl|gnu general public L (?:version |v)?[123](?: 0)?
gpl|general public L (?:version |v)?[123](?: 0)?
gpl|gnu gpl (?:version |v)?[123](?: 0)?
gpl|gpl (?:version |v)?[123](?: 0)?
gpl|gplv1
gpl|gplv2
gpl|gplv3
lgpl|gnu (?:lesser|library) general public L (?:version |v)?[23](?: [01])?
lgpl|lesser general public L (?:version |v)?[23](?: [01])?
lgpl|lgpl (?:version |v)?[23](?: [01])?
lgpl|lgplv2(?: 1)?
lgpl|lgplv3
agpl|gnu affero general public L (?:version |v)?[13](?: 0)?
agpl|agpl (?:version |v)?[13](?: 0)?
agpl|agplv1
agpl|agplv3
mpl|mozilla public L (?:version |v)?[12](?: [01])?
mpl|mpl (?:version |v)?[12](?: [01])?
epl|eclipse public L (?:version |v)?[12](?: 0)?
epl|epl (?:version |v)?[12](?: 0)?
cpl|common public L (?:version |v)?1(?: 0)?
cddl|common development and distribution L (?:version |v)?1(?: [01])?
cddl|cddl (?:version |v)?1(?: [01])?
eupl|european union public L (?:version |v)?1(?: [012])?
eupl|eupl (?:version |v)?1(?: [012])?
artistic|(?:perl )?artistic L (?:version |v)?[12](?: 0)?
boost|boost software L (?:version |v)?1(?: 0)?
wtfpl|wtfpl (?:version |v)?2
ofl|(?:sil )?open font L (?:version |v)?1(?: [01])?
ofl|(?:sil )?ofl (?:version |v)?1(?: [01])?
osl|open software L (?:version |v)?[123](?: [01])?
osl|osl (?:version |v)?[123](?: [01])?
afl|academic free L (?:version |v)?[123](?: [012])?
afl|afl (?:version |v)?[123](?: [012])?
ecl|educational community L (?:version |v)?[12](?: 0)?
lppl|latex project public L (?:version |v)?1(?: [0123])?c?
lppl|lppl (?:version |v)?1(?: [0123])?c?
psf|python (?:software foundation )?L (?:version |v)?2(?: 0)?
php|php L (?:version |v)?3(?: 01?)?
odbl|open database L (?:version |v)?1(?: 0)?
odbl|odbl (?:version |v)?1(?: 0)?
fdl|(?:gnu )?free documentation L (?:version |v)?1(?: [0123])?
fdl|gfdl (?:version |v)?1(?: [0123])?
bsl|business source L (?:version |v)?1(?: [01])?
sspl|server side public L (?:version |v)?1
sspl|sspl (?:version |v)?1
elastic|elastic L (?:version |v)?2(?: 0)?
upl|universal permissive L (?:version |v)?1(?: 0)?
cc0|cc0 1 0
cc0|creative commons zero (?:version |v)?1(?: 0)?
cc-by|cc by \d \d
cc-by-sa|cc by sa \d \d
cc-by-nc|cc by nc \d \d
cc-by-nd|cc by nd \d \d
cc-by-nc-sa|cc by nc sa \d \d
cc-by-nc-nd|cc by nc nd \d \d
bsd-2-clause|bsd 2 clause
bsd-2-clause|two clause bsd
bsd-3-clause|bsd 3 clause
bsd-3-clause|three clause bsd
bsd-4-clause|bsd 4 clause
"""

#: Names with a word of licensing.
NAMES = """
mit|mit (?:x11 )?L
mit|mit style L
mit|expat L
mit|x11 L
mit|(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)
apache|apache (?:software )?L
apache|(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:apache|asl)
gpl|(?:gnu )?general public L
gpl|gnu gpl
gpl|gpl L
gpl|gpl compatible
gpl|(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
lgpl|(?:gnu )?(?:lesser|library) general public L
lgpl|lgpl L
lgpl|(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
agpl|(?:gnu )?affero general public L
agpl|agpl L
agpl|(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
bsd|(?:simplified |modified |new |revised |original )?bsd L
bsd|freebsd L
bsd|bsd style L
bsd|(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the |a )?(?:simplified |modified |new )?bsd
isc|isc L
mpl|mozilla public L
mpl|mpl L
mpl|(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:mpl|mozilla)
epl|eclipse public L
cpl|common public L
cddl|common development and distribution L
cddl|cddl L
eupl|european union public L
zlib|zlib(?: libpng)? L
artistic|(?:perl )?artistic L
boost|boost software L
unlicense|the unlicense
unlicense|(?:licensed|released|distributed|available|published|covered) under the unlicense
wtfpl|wtfpl L
wtfpl|do what the fuck you want to public L
ofl|(?:sil )?open font L
osl|open software L
afl|academic free L
ecl|educational community L
lppl|latex project public L
psf|python software foundation L
psf|psf L
php|php L
ruby|ruby L
ncsa|(?:university of illinois )?ncsa (?:open source )?L
openssl|openssl L
postgresql|postgresql L
ms-pl|microsoft public L
ms-rl|microsoft reciprocal L
odbl|open database L
fdl|(?:gnu )?free documentation L
bsl|business source L
sspl|server side public L
elastic|elastic L
upl|universal permissive L
cc0|creative commons zero
cc0|cc0 L
cc-by|creative commons attribution
cc-by-sa|creative commons attribution share ?alike
cc-by-nc|creative commons attribution non ?commercial
cc-by-nd|creative commons attribution no ?deriv(?:ative)?s
cc-by-nc-sa|creative commons attribution non ?commercial share ?alike
cc-by-nc-nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc|creative commons L
beerware|beer ware L
beerware|the beerware L
vim|vim L
json|the software shall be used for good not evil
public-domain|public domain dedication
"""

#: Words that only point at licensing.
MENTIONS = """
proprietary|all rights reserved
copyleft|copyleft L
permissive|permissive L
gpl|copyleft
open-source|open source L
open-source|osi approved L
free-software|free software L
commercial|commercial L
commercial|L key required
commercial|end user L agreement
commercial|eula
creative-commons|creative commons
"""

SECTIONS = (CLAUSES, IDENTIFIERS, VERSIONED, NAMES, MENTIONS)


_GROUP = re.compile(r"\(\?:([^()]*)\)(\??)")


def gates(rx: str) -> tuple[list[str], list[str]]:
    """Words that every match holds, and alternatives of which every match holds one (empty: no such group)."""
    either: list[str] = []

    def bare(m: re.Match) -> str:
        parts = m[1].split("|")
        if m[2] and (all(x.endswith(" ") for x in parts) or all(x.startswith(" ") for x in parts)):
            return ""  # whole words that may be absent
        before = m.string[: m.start()]
        if not m[2] and before.count("(") == before.count(")") and all(x.isalnum() for x in parts) and m.string[m.end() : m.end() + 1] in ("", " ") and m.string[m.start() - 1 : m.start()] in ("", " ", ")"):
            either[:] = parts
        return "#"

    while (less := _GROUP.sub(bare, rx)) != rx:
        rx = less
    words = rx.split(" ")
    whole = [w for w, after in zip(words, [*words[1:], ""], strict=True) if w.isalnum() and not after.startswith("?")]
    return sorted(set(whole), key=len, reverse=True)[:3], either


def signatures() -> list[tuple[int, str, str]]:
    """(priority, label, regex) of every signature, in order."""
    out = []
    for priority, section in enumerate(SECTIONS):
        for line in section.strip().split("\n"):
            label, words = line.split("|", 1)
            out.append((priority, label.replace(" ", "."), re.sub(r"(?<![A-Za-z])L(?![A-Za-z])", "licen[cs]e", words)))
    return out
