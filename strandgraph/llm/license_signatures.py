"""Hand-written signatures of licence texts, headers and notices, over normal form: lower-case words between single spaces.

Each line: label, confidence, and a regular expression; `..` stands for up to six words of any kind. Sections are in order
of priority: a text's whole header says more than a clause of it, and a clause more than a remark.
"""

#: Headers, grants and tags that name the licence and its terms.
HEADERS = r"""
apache-2.0 | 1.0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 1.0 | you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | 0.95 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | 0.95 | apache org licenses license 2 0
apache-2.0 | 0.95 | opensource org licenses apache 2 0
apache-2.0 | 0.95 | version 2(?: 0)? of the apache (?:software )?license
apache-1.1 | 0.95 | version 1 1 of the apache (?:software )?license
gpl-2.0-or-later | 1.0 | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | 1.0 | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only | 1.0 | gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-3.0-only | 1.0 | gnu general public license version 3 (?:only )?as published by the free software foundation
lgpl-2.1-or-later | 1.0 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | 1.0 | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later | 1.0 | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3.0-or-later | 1.0 | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-1.0-or-later | 1.0 | gnu general public license as published by the free software foundation either version 1 or at your option any later version
gpl-2.0 | 0.95 | version 2(?: 0)? of the (?:gnu )?(?:general public license|gpl)
gpl-3.0 | 0.95 | version 3(?: 0)? of the (?:gnu )?(?:general public license|gpl)
gpl-1.0 | 0.95 | version 1(?: 0)? of the (?:gnu )?(?:general public license|gpl)
lgpl-2.1 | 0.95 | version 2 1 of the (?:gnu )?(?:lesser general public license|lgpl)
lgpl-3.0 | 0.95 | version 3(?: 0)? of the (?:gnu )?(?:lesser general public license|lgpl)
agpl-3.0 | 0.95 | version 3(?: 0)? of the (?:gnu )?(?:affero general public license|agpl)
mpl-2.0 | 0.95 | version 2(?: 0)? of the mozilla public license
mpl-1.1 | 0.95 | version 1 1 of the mozilla public license
epl-2.0 | 0.95 | version 2(?: 0)? of the eclipse public license
epl-1.0 | 0.95 | version 1(?: 0)? of the eclipse public license
gpl | 0.9 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | 0.9 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
gpl | 0.9 | you should have received a copy of the gnu general public license along with
lgpl | 0.9 | you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl-3.0 | 0.9 | you should have received a copy of the gnu affero general public license along with
mpl-2.0 | 1.0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 0.95 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | 1.0 | the contents of this file are subject to the mozilla public license version 1 1
cddl-1.0 | 1.0 | the contents of this file are subject to the terms of the common development and distribution license
epl-1.0 | 1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | 1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0
cpl-1.0 | 1.0 | this program and the accompanying materials are made available under the terms of the common public license
mit | 0.95 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:permissive )?mit(?: x11)? license
mit | 0.95 | opensource org licenses mit
mit | 0.9 | the mit license mit
mit | 0.9 | license mit
bsd | 0.95 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?bsd(?: style)? license
bsd-2-clause | 0.95 | (?:2|two) clause bsd(?: license)?
bsd-3-clause | 0.95 | (?:3|three) clause bsd(?: license)?
bsd-4-clause | 0.95 | (?:4|four) clause bsd(?: license)?
bsd-2-clause | 0.95 | opensource org licenses bsd 2 clause
bsd-3-clause | 0.95 | opensource org licenses bsd 3 clause
bsd | 0.9 | use of this source code is governed by a bsd style license that can be found in the license file
isc | 0.95 | opensource org licenses isc
zlib | 0.95 | opensource org licenses zlib
artistic-2.0 | 0.95 | you (?:can|may) redistribute it and or modify it under the terms of the artistic license
perl | 0.95 | you can redistribute it and or modify it under the same terms as perl(?: itself)?
python-2.0 | 0.95 | licensed to psf under a contributor agreement
php-3.01 | 0.95 | this source file is subject to version 3 0?1 of the php license
ruby | 0.9 | (?:under|by) the (?:same terms as|terms of) (?:the )?ruby(?: s)? license
bsl-1.0 | 1.0 | distributed under the boost software license version 1 0
bsl-1.0 | 0.95 | boost org license 1 0 txt
ofl-1.1 | 1.0 | this font software is licensed under the sil open font license version 1 1
eupl-1.2 | 0.95 | licensed under the eupl(?: version 1 [12])?
cecill-2.1 | 0.95 | governed by the cecill(?: [abc])? license
afl-3.0 | 0.95 | licensed under the academic free license version 3 0
osl-3.0 | 0.95 | licensed under the open software license version 3 0
ms-rl | 0.95 | licensed under the microsoft reciprocal license
ncsa | 0.95 | university of illinois (?:ncsa )?open source license
upl-1.0 | 0.95 | licensed under the universal permissive license
busl-1.1 | 0.95 | (?:licensed|use of this software is governed) (?:under|by) the business source license
sspl-1.0 | 0.95 | server side public license
elastic-2.0 | 0.95 | (?:licensed under|subject to) the elastic license
commons-clause | 0.95 | commons clause license condition v1 0
mulan-psl-2.0 | 0.95 | licensed under mulan psl v2
cc0-1.0 | 1.0 | to the extent possible under law .. has waived all copyright and related or neighboring rights
cc0-1.0 | 0.95 | creativecommons org publicdomain zero 1 0
public-domain | 0.95 | creativecommons org publicdomain mark 1 0
cc-by-sa-4.0 | 1.0 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 1.0 | creativecommons org licenses by sa 3 0
cc-by-4.0 | 1.0 | creativecommons org licenses by 4 0
cc-by-3.0 | 1.0 | creativecommons org licenses by 3 0
cc-by-nc-4.0 | 1.0 | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | 1.0 | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | 1.0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 1.0 | creativecommons org licenses by nc nd 4 0
cc | 0.9 | (?:this work|this article|this book|this image|except where otherwise noted content on this site) is licensed under (?:a|the) creative commons
cc | 0.85 | some rights reserved creative commons
odbl-1.0 | 0.95 | made available under the open database license
odbl-1.0 | 0.9 | contains information from .. which is made available here under the open database license
ogl-3.0 | 0.95 | contains public sector information licensed under the open government licence
gfdl | 1.0 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
"""

#: Clauses of licence texts.
CLAUSES = r"""
mit | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
bsl-1.0 | 0.95 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
ofl-1.1 | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of the font software
unicode | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
mit | 0.9 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
mit | 0.9 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
x11 | 0.9 | except as contained in this notice the names? of .. shall not be used in advertising or otherwise to promote
isc | 0.95 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | 0.8 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
hpnd | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
postgresql | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
bsd | 0.95 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 0.9 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 0.9 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | 0.95 | neither the names? of .. nor the names of (?:its|their|other|any) contributors may be used to endorse or promote products derived from this software
bsd-3-clause | 0.9 | the names? of (?:the |its )?(?:authors?|contributors?|copyright holders?) may not be used to endorse or promote products derived from this software
bsd-4-clause | 0.95 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 0.8 | this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?|project) as is
bsd | 0.8 | in no event shall the (?:copyright (?:owner|holder)s?|regents|authors?|project)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages
bsd-3-clause-clear | 0.9 | no express or implied licenses to any party s patent rights are granted by this license
zlib | 0.95 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 0.95 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 0.9 | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
apache-2.0 | 0.95 | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | 0.95 | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable .. patent license
apache-2.0 | 0.9 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 0.9 | terms and conditions for use reproduction and distribution
apache-1.1 | 0.9 | this product includes software developed by the apache software foundation
openssl | 0.95 | this product includes software developed by the openssl project
ssleay | 0.95 | this product includes cryptographic software written by eric young
gpl | 0.95 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | 0.9 | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | 0.95 | the gnu general public license is a free copyleft license for software and other kinds of works
agpl-3.0 | 0.95 | the gnu affero general public license is a free copyleft license for software and other kinds of works
gpl-2.0 | 0.9 | you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program
gpl-2.0 | 0.9 | you may copy and distribute verbatim copies of the program s source code as you receive it in any medium
gpl-3.0 | 0.9 | you may convey verbatim copies of the program s source code as you receive it in any medium
agpl-3.0 | 0.95 | if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
lgpl-2.1 | 0.9 | this license the lesser general public license applies to some specially designated software packages
lgpl | 0.9 | a program that contains no derivative of any portion of the library but is designed to work with the library
lgpl-3.0 | 0.9 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
classpath-exception | 0.95 | linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception | 0.95 | gcc runtime library exception
font-exception | 0.9 | if you create a document which uses this font and embed this font or unaltered portions of this font into the document
autoconf-exception | 0.9 | as a special exception the free software foundation gives unlimited permission to copy distribute and modify
linking-exception | 0.8 | as a special exception .. (?:permission to link|gives? (?:you )?permission to link)
gpl | 0.7 | this program is distributed in the hope that it will be useful but without any warranty
lgpl | 0.7 | this library is distributed in the hope that it will be useful but without any warranty
mpl-2.0 | 0.9 | each contributor hereby grants you a world wide royalty free non exclusive license
mpl | 0.9 | if it is impossible for you to comply with any of the terms of this license with respect to some or all of the covered software
epl | 0.9 | any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
cddl-1.0 | 0.9 | this code is distributed under the cddl
artistic | 0.9 | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | 0.9 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
python-2.0 | 0.9 | psf is making python available to licensee on an as is basis
unlicense | 0.95 | this is free and unencumbered software released into the public domain
unlicense | 0.9 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | 0.95 | you just do what the fuck you want to
beerware | 0.95 | if we meet some day and you think this stuff is worth it you can buy me a beer in return
json | 0.95 | the software shall be used for good not evil
ofl-1.1 | 0.9 | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
ofl-1.1 | 0.9 | neither the font software nor any of its individual components in original or modified versions may be sold by itself
cc0-1.0 | 0.9 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc | 0.9 | by exercising the licensed rights .. you accept and agree to be bound by the terms and conditions
cc-by | 0.9 | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | 0.9 | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nd | 0.9 | if you remix transform or build upon the material you may not distribute the modified material
cc-by-nc | 0.9 | you may not use the material for commercial purposes
odbl-1.0 | 0.9 | you are free to share to create and to adapt as long as you attribute share alike and keep open
openrail | 0.9 | use restrictions set forth in attachment a
llama | 0.9 | if .. the monthly active users of the products or services .. is greater than 700 million
busl-1.1 | 0.9 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
sspl-1.0 | 0.9 | making the functionality of the program or modified version available to third parties as a service
elastic-2.0 | 0.9 | you may not provide the software to third parties as a hosted or managed service
commons-clause | 0.9 | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
ms-pl | 0.9 | if you bring a patent claim against any contributor over patents that you claim are infringed by the software
curl | 0.9 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
libtiff | 0.9 | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
libpng | 0.9 | the png reference library is supplied as is
ijg | 0.9 | this software is based in part on the work of the independent jpeg group
w3c | 0.9 | permission to copy modify and distribute this (?:software|work|document) and its documentation with or without modification for any purpose and without fee or royalty is hereby granted
ietf | 0.9 | this document is subject to bcp 78 and the ietf trust s legal provisions
"""

#: Notices, and remarks about rights.
REMARKS = r"""
permissive | 0.8 | permission is hereby granted free of charge
permissive | 0.8 | redistribution and use in source and binary forms
permissive | 0.6 | free to (?:use|copy|share|distribute) (?:copy |share |distribute |modify )?(?:and |or )?(?:use|copy|share|distribute|modify)(?: it)?(?: for any purpose)?
dual | 0.8 | (?:dual|triple|tri) licensed(?: under)?
dual | 0.8 | alternatively .. may be used under the terms of
dual | 0.7 | at your option(?: under)? either
public-domain | 0.8 | (?:dedicated|released|placed|released in)(?: in)?(?: to| into)? the public domain
public-domain | 0.8 | no (?:known )?copyright (?:restrictions|is claimed|exists)
public-domain | 0.8 | not subject to copyright protection
public-domain | 0.8 | work of the (?:u s|united states|us) (?:federal )?government
public-domain | 0.7 | copyright (?:has|have) (?:been waived|expired)
cc | 0.7 | some rights reserved
reserved | 0.7 | all (?:other )?rights (?:are|remain) reserved
reserved | 0.7 | no rights? (?:is|are) granted
proprietary | 0.8 | (?:strictly )?confidential(?: and proprietary)?(?: information)? do not (?:distribute|copy|share)
proprietary | 0.8 | proprietary and confidential
proprietary | 0.8 | confidential and proprietary
proprietary | 0.8 | unauthori[sz]ed (?:copying|reproduction|use|distribution|duplication)(?: and distribution)?(?: of this (?:file|work|material|document|software))?(?: via any medium)? is (?:strictly )?(?:prohibited|forbidden)
proprietary | 0.7 | (?:may|must|shall) not be (?:reproduced|copied|republished|redistributed)(?: or (?:distributed|transmitted|redistributed|used))?
proprietary | 0.7 | no part of this (?:publication|book|work|document|site|article) may be (?:reproduced|copied|stored|used)
proprietary | 0.7 | without (?:the )?(?:prior |express |explicit )*(?:written )?(?:permission|consent) (?:of|from) the (?:author|publisher|owner|copyright holder|copyright owner)s?
proprietary | 0.7 | end user license agreement
proprietary | 0.7 | (?:is|are) the (?:sole |exclusive )?(?:intellectual )?property of
proprietary | 0.6 | reverse engineer decompile or disassemble
proprietary | 0.6 | for (?:internal|evaluation) use only
noncommercial | 0.8 | for (?:personal )?noncommercial (?:use|purposes)(?: only)?
noncommercial | 0.8 | for (?:personal )?non commercial (?:use|purposes)(?: only)?
noncommercial | 0.8 | not for (?:commercial|resale) (?:use|purposes)
noncommercial | 0.8 | commercial use (?:is )?(?:prohibited|forbidden|not (?:allowed|permitted))
noncommercial | 0.7 | for (?:personal|educational|academic|research)(?: (?:and|or) (?:personal|educational|academic|research))? (?:use|purposes) only
no-derivatives | 0.7 | no derivative works
no-training | 0.9 | (?:may|must|shall|can) not be used (?:to train|for training|in training)(?: of)?
no-training | 0.9 | text and data mining (?:is|are|rights)(?: not| expressly)? (?:permitted|allowed|reserved)
fair-use | 0.6 | fair (?:use|dealing) (?:notice|of copyrighted material)
copyright | 0.6 | copyright (?:c |© )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright | 0.6 | (?:c|©) copyright (?:19|20)[0-9][0-9]
copyright | 0.6 | © (?:19|20)[0-9][0-9](?: [^ ]+){0,3} rights reserved
copyright | 0.5 | copyrighted material
copyright | 0.5 | protected by copyright(?: law)?s?
trademark | 0.5 | (?:is|are) (?:a )?(?:registered )?trade ?marks?(?: or registered trade ?marks?)? of
patent | 0.5 | patents? pending
warranty | 0.5 | without (?:any )?warrant(?:y|ies)(?: or conditions)? of any kind
warranty | 0.5 | implied warrant(?:y|ies) of merchantability
warranty | 0.4 | (?:is )?provided as is
warranty | 0.4 | use at your own risk
contribution | 0.5 | developer certificate of origin
contribution | 0.5 | contributor licen[cs]e agreement
"""


def parse(section: str) -> list[tuple[str, float, str]]:
    """(label, confidence, pattern) of each line; words stand as Latin-1 characters of their bytes, as in normal form."""
    out = []
    for line in section.strip().splitlines():
        label, confidence, pattern = (part.strip() for part in line.split(" | ", 2))
        out.append((label, float(confidence), pattern.replace(" .. ", "(?: [^ ]+){0,6} ").encode().decode("latin-1")))
    return out
