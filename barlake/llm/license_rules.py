"""Signature rules of the license scan: sentences of license texts, notices and headers, tags, and names, written one by one.

A line is label | priority | keyword | pattern. Patterns are regular expressions over lower-case words with one space between
(letters, digits and everything beyond ASCII are words). A rule is tried only where its keyword stands. Priorities: 100 a tag,
95 a sentence of the license's own text, 90 a notice that grants, 80 a header or badge, 60 a name with its version, 50 a bare name.
"""

RULES = r"""
mit | 100 | license identifier | spdx license identifier mit
apache-2 | 100 | license identifier | spdx license identifier apache 2 0
gpl-2 | 100 | license identifier | spdx license identifier gpl 2 0(?: only)?
gpl-2 | 100 | license identifier | spdx license identifier gpl 2 0 or later
gpl-3 | 100 | license identifier | spdx license identifier gpl 3 0(?: only)?
gpl-3 | 100 | license identifier | spdx license identifier gpl 3 0 or later
lgpl-2.1 | 100 | license identifier | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 | 100 | license identifier | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3 | 100 | license identifier | spdx license identifier agpl 3 0(?: only| or later)?
mpl-2 | 100 | license identifier | spdx license identifier mpl 2 0
bsd-2 | 100 | license identifier | spdx license identifier bsd 2 clause
bsd-3 | 100 | license identifier | spdx license identifier bsd 3 clause
isc | 100 | license identifier | spdx license identifier isc
unlicense | 100 | license identifier | spdx license identifier unlicense
cc0 | 100 | license identifier | spdx license identifier cc0 1 0
cc-by | 100 | license identifier | spdx license identifier cc by [1-4] 0
cc-by-sa | 100 | license identifier | spdx license identifier cc by sa [1-4] 0
cc-by-nc | 100 | license identifier | spdx license identifier cc by nc [1-4] 0
epl | 100 | license identifier | spdx license identifier epl [12] 0
zlib | 100 | license identifier | spdx license identifier zlib
boost | 100 | license identifier | spdx license identifier bsl 1 0
ofl | 100 | license identifier | spdx license identifier ofl 1 1
mit | 95 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 95 | without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit | 95 | above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 80 | provided as is | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
isc | 95 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 95 | and the author disclaims | the software is provided as is and the author disclaims all warranties with regard to this software
bsd | 95 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 95 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 95 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3 | 95 | endorse or promote | neither the name of (?:\S+ ){1,12}may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3 | 95 | endorse or promote | the names? of (?:\S+ ){1,12}may not be used to endorse or promote products derived from this software
bsd-4 | 95 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | 95 | apache org licenses | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2 | 95 | except in compliance | you may not use this file except in compliance with the license
apache-2 | 95 | terms and conditions for use | terms and conditions for use reproduction and distribution
apache-2 | 95 | grant of copyright | grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you
apache-2 | 95 | grant of patent | grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you
apache-1.1 | 95 | apache software foundation | this product includes software developed by the apache software foundation
gpl | 95 | free software you can redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl-2 | 95 | either version 2 | either version 2 of the licen[cs]e or at your option any later version
gpl-3 | 95 | either version 3 | either version 3 of the licen[cs]e or at your option any later version
gpl | 95 | you should have received | you should have received a copy of the gnu general public licen[cs]e along with this program
gpl | 95 | useful but without | (?:this program|it) is distributed in the hope that it will be useful but without any warranty
gpl | 95 | everyone is permitted | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
lgpl | 95 | lesser general public | you should have received a copy of the gnu lesser general public licen[cs]e
lgpl | 95 | library is free software | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
agpl-3 | 95 | affero | you should have received a copy of the gnu affero general public licen[cs]e
agpl-3 | 95 | interacting with it remotely | all users interacting with it remotely through a computer network
mpl-2 | 95 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0
mpl-1.1 | 95 | mozilla | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl-2 | 95 | mozilla org | if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0
epl | 95 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
cddl | 95 | common development | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
unlicense | 95 | unencumbered | this is free and unencumbered software released into the public domain
cc0 | 95 | waived all copyright | has waived all copyright and related or neighboring rights to this work
cc0 | 95 | no rights reserved | cc0 no rights reserved
zlib | 95 | express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 95 | origin of this software | the origin of this software must not be misrepresented
zlib | 95 | altered source versions | altered source versions must be plainly marked as such
boost | 95 | boost | distributed under the boost software licen[cs]e version 1 0
wtfpl | 95 | what the fuck | you just do what the fuck you want to
beerware | 95 | buy me a beer | you can buy me a beer in return
ofl | 95 | open font | this font software is licensed under the sil open font licen[cs]e
artistic | 95 | artistic | under the same terms as perl itself|under the terms of the artistic licen[cs]e
python | 95 | python software foundation | python software foundation licen[cs]e version 2
openssl | 95 | openssl | this product includes software developed by the openssl project
json | 95 | for good | the software shall be used for good not evil
ms-pl | 95 | microsoft public | microsoft public licen[cs]e ms pl
odbl | 95 | open database | made available under the open database licen[cs]e
pddl | 95 | public domain dedication | public domain dedication and licen[cs]e
gfdl | 95 | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
cc-by | 95 | creative commons | this work is licensed under (?:a|the) creative commons attribution [1-4] [05] (?:international|unported|generic) licen[cs]e
cc-by-sa | 95 | creative commons | this work is licensed under (?:a|the) creative commons attribution share ?alike [1-4] [05]
cc-by-nc | 95 | creative commons | this work is licensed under (?:a|the) creative commons attribution non ?commercial [1-4] [05]
cc-by-nc-sa | 95 | creative commons | this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike [1-4] [05]
cc-by-nc-nd | 95 | creative commons | this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s [1-4] [05]
cc-by-nd | 95 | creative commons | this work is licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s [1-4] [05]
cc-by | 90 | creativecommons org | creativecommons org licenses by [1-4] [05]
cc-by-sa | 90 | creativecommons org | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | 90 | creativecommons org | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | 90 | creativecommons org | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | 90 | creativecommons org | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nd | 90 | creativecommons org | creativecommons org licenses by nd [1-4] [05]
cc0 | 90 | creativecommons org | creativecommons org publicdomain zero 1 0
public-domain | 90 | creativecommons org | creativecommons org publicdomain mark 1 0
mit | 90 | mit | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?
mit | 90 | mit | under the (?:terms of the )?mit licen[cs]e
mit | 90 | mit | (?:use|usage) (?:of this (?:software|source code) )?is governed by an mit style licen[cs]e
mit | 90 | opensource org | opensource org licenses mit(?: license)?
apache-2 | 90 | apache | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?
apache-2 | 90 | apache | under the apache licen[cs]e(?: version)? v?2(?: 0)?
apache | 90 | apache | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache licen[cs]e
gpl-2 | 90 | gpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?v?2(?: 0)?
gpl-3 | 90 | gpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?v?3(?: 0)?
gpl-2 | 90 | general public | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e(?: as published by the free software foundation)? version 2
gpl-3 | 90 | general public | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e(?: as published by the free software foundation)? version 3
gpl | 90 | general public | under the terms of the gnu general public licen[cs]e
gpl | 90 | gnu org | gnu org licenses gpl
gpl-3 | 90 | gnu org | gnu org licenses gpl 3 0
gpl-2 | 90 | gnu org | gnu org licenses (?:old licenses )?gpl 2 0
lgpl | 90 | gnu org | gnu org licenses lgpl
agpl-3 | 90 | gnu org | gnu org licenses agpl(?: 3 0)?
lgpl | 90 | lesser general public | under the terms of the gnu lesser general public licen[cs]e
lgpl-2.1 | 90 | lgpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?lgpl ?v?2 1
lgpl-3 | 90 | lgpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?lgpl ?v?3(?: 0)?
agpl-3 | 90 | affero | under the terms of the gnu affero general public licen[cs]e
agpl-3 | 90 | agpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?agpl ?v?3(?: 0)?
mpl-2 | 90 | mpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mpl ?v?2(?: 0)?
mpl-2 | 90 | mozilla | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e(?: version)? v?2(?: 0)?
bsd-2 | 90 | bsd | (?:licensed|released|distributed|available) under (?:a |the )?(?:terms of (?:the )?)?(?:2 clause bsd|bsd 2 clause|simplified bsd)
bsd-3 | 90 | bsd | (?:licensed|released|distributed|available) under (?:a |the )?(?:terms of (?:the )?)?(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd)
bsd | 90 | bsd | governed by a bsd style licen[cs]e
bsd | 90 | bsd | (?:licensed|released|distributed|available) under (?:a |the )?(?:terms of (?:the )?)?bsd(?: style)? licen[cs]e
isc | 90 | isc | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc licen[cs]e
epl | 90 | eclipse | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e
eupl | 90 | european union | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?european union public licen[cs]e
zlib | 90 | zlib | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?zlib(?: libpng)? licen[cs]e
boost | 90 | boost | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?boost software licen[cs]e
unlicense | 90 | unlicense | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?unlicense
unlicense | 90 | unlicense org | unlicense org
cc0 | 90 | cc0 | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?cc0
cc-by | 90 | cc by | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by(?: [1-4] [05])?
cc-by-sa | 90 | cc by | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by sa(?: [1-4] [05])?
cc-by-nc | 90 | cc by | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nc(?: [1-4] [05])?
cc-by-nc-sa | 90 | cc by | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 90 | cc by | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nc nd(?: [1-4] [05])?
cc-by-nd | 90 | cc by | (?:licensed|released|distributed|available|published) under (?:a |the )?cc by nd(?: [1-4] [05])?
public-domain | 90 | public domain | (?:dedicated|released|placed|put) (?:in|to|into) the public domain
public-domain | 90 | public domain | this (?:file|work|code|software|document) is (?:in|placed in) the public domain
proprietary | 90 | proprietary and confidential | proprietary and confidential
proprietary | 90 | strictly prohibited | unauthori[sz]ed copying (?:of this file )?(?:via any medium )?is strictly prohibited
proprietary | 90 | prior written permission | no part of this (?:publication|work|document|book) may be reproduced
proprietary | 90 | not be reproduced | may not be reproduced (?:distributed )?(?:or transmitted )?in any form
proprietary | 90 | end user license | end user licen[cs]e agreement
proprietary | 90 | internal use only | for internal use only
mit | 80 | license mit | licen[cs]e mit(?: licen[cs]e)?
mit | 80 | mit license | the mit licen[cs]e mit
mit | 80 | mit | mit x11 licen[cs]e|x11 mit licen[cs]e|expat licen[cs]e
apache-2 | 80 | license apache | licen[cs]e apache(?: licen[cs]e)?(?: version)? ?v?2(?: 0)?
gpl-2 | 80 | license gpl | licen[cs]e gpl ?v?2(?: 0)?
gpl-3 | 80 | license gpl | licen[cs]e gpl ?v?3(?: 0)?
gpl | 80 | module license gpl | module license gpl(?: v2)?
lgpl | 80 | license lgpl | licen[cs]e lgpl ?(?:v?[23](?: [01])?)?
agpl-3 | 80 | license agpl | licen[cs]e agpl ?v?3?(?: 0)?
bsd-3 | 80 | license bsd | licen[cs]e bsd 3 clause
bsd-2 | 80 | license bsd | licen[cs]e bsd 2 clause
bsd | 80 | license bsd | licen[cs]e bsd
isc | 80 | license isc | licen[cs]e isc
mpl-2 | 80 | license mpl | licen[cs]e mpl ?v?2(?: 0)?
cc0 | 80 | license cc0 | licen[cs]e cc0(?: 1 0)?
cc-by | 80 | license cc by | licen[cs]e cc by(?: [1-4] [05])?
cc-by-sa | 80 | license cc by | licen[cs]e cc by sa(?: [1-4] [05])?
cc-by-nc | 80 | license cc by | licen[cs]e cc by nc(?: [1-4] [05])?
cc-by-nc-sa | 80 | license cc by | licen[cs]e cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 80 | license cc by | licen[cs]e cc by nc nd(?: [1-4] [05])?
unlicense | 80 | license unlicense | licen[cs]e unlicense
proprietary | 80 | license proprietary | licen[cs]e proprietary
proprietary | 80 | all rights reserved | copyright (?:c )?(?:\S+ ){0,8}all rights reserved
apache-2 | 60 | apache | apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?
apache-2 | 60 | apache 2 0 | apache 2 0(?: licen[cs]e)?
apache-1.1 | 60 | apache | apache(?: software)? licen[cs]e(?: version)? 1 1
gpl-2 | 60 | gpl | gpl ?v?2(?: 0)?
gpl-3 | 60 | gpl | gpl ?v?3(?: 0)?
gpl-2 | 60 | general public | general public licen[cs]e(?: version)? v?2(?: 0)?
gpl-3 | 60 | general public | general public licen[cs]e(?: version)? v?3(?: 0)?
lgpl-2.1 | 60 | lgpl | lgpl ?v?2 1
lgpl-3 | 60 | lgpl | lgpl ?v?3(?: 0)?
lgpl-2.1 | 60 | lesser general public | lesser general public licen[cs]e(?: version)? v?2 1
lgpl-3 | 60 | lesser general public | lesser general public licen[cs]e(?: version)? v?3(?: 0)?
agpl-3 | 60 | agpl | agpl ?v?3(?: 0)?
agpl-3 | 60 | affero | affero general public licen[cs]e(?: version)? v?3(?: 0)?
mpl-2 | 60 | mozilla | mozilla public licen[cs]e(?: version)? v?2(?: 0)?
mpl-1.1 | 60 | mozilla | mozilla public licen[cs]e(?: version)? v?1 1
epl | 60 | eclipse | eclipse public licen[cs]e(?: version)? v?[12](?: 0)?
cddl | 60 | cddl | cddl(?: 1 [01])?
eupl | 60 | eupl | eupl(?: v?1 [012])?
bsd-2 | 60 | bsd | (?:simplified|2 clause|two clause) bsd(?: licen[cs]e)?
bsd-2 | 60 | bsd | bsd 2 clause(?: licen[cs]e)?
bsd-3 | 60 | bsd | (?:new|revised|modified|3 clause|three clause) bsd(?: licen[cs]e)?
bsd-3 | 60 | bsd | bsd 3 clause(?: licen[cs]e)?
bsd-4 | 60 | bsd | (?:original|4 clause|four clause) bsd(?: licen[cs]e)?
artistic | 60 | artistic | artistic licen[cs]e [12] 0
boost | 60 | boost | boost software licen[cs]e(?: version)? 1 0
ofl | 60 | open font | (?:sil )?open font licen[cs]e(?: version)? 1 1
gfdl | 60 | free documentation | gnu free documentation licen[cs]e(?: version)? 1 [123]
cc-by | 60 | cc by | cc by [1-4] [05]
cc-by-sa | 60 | cc by | cc by sa [1-4] [05]
cc-by-nc | 60 | cc by | cc by nc [1-4] [05]
cc-by-nc-sa | 60 | cc by | cc by nc sa [1-4] [05]
cc-by-nc-nd | 60 | cc by | cc by nc nd [1-4] [05]
cc-by-nd | 60 | cc by | cc by nd [1-4] [05]
cc0 | 60 | cc0 | cc0 1 0(?: universal)?
mit | 50 | mit license | mit licen[cs]e
mit | 50 | mit licence | mit licence
apache | 50 | apache license | apache licen[cs]e
gpl | 50 | general public license | (?:gnu )?general public license
lgpl | 50 | lesser general public | (?:gnu )?lesser general public licen[cs]e
agpl-3 | 50 | affero | (?:gnu )?affero general public licen[cs]e
mpl | 50 | mozilla public | mozilla public licen[cs]e
bsd | 50 | bsd license | bsd license
isc | 50 | isc license | isc license
epl | 50 | eclipse public | eclipse public licen[cs]e
zlib | 50 | zlib license | zlib license
artistic | 50 | artistic license | artistic license
unlicense | 50 | unlicense | unlicense
wtfpl | 50 | wtfpl | wtfpl
beerware | 50 | beerware | beerware(?: licen[cs]e)?
odbl | 50 | odbl | odbl
cc0 | 50 | cc0 | cc0
cc-by | 50 | cc by | cc by
cc-by-sa | 50 | cc by sa | cc by sa
cc-by-nc | 50 | cc by nc | cc by nc
cc-by-nc-sa | 50 | cc by nc sa | cc by nc sa
cc-by-nc-nd | 50 | cc by nc nd | cc by nc nd
cc-by-nd | 50 | cc by nd | cc by nd
cc-by | 50 | creative commons | creative commons attribution
cc-by-sa | 50 | creative commons | creative commons attribution share ?alike
cc-by-nc | 50 | creative commons | creative commons attribution non ?commercial
public-domain | 50 | public domain | public domain
proprietary | 50 | all rights reserved | all rights reserved
"""
