"""Licence signatures: ordered rules over normalised text.

A line is ``label | keyword | regex``. The text they see is lower case, its
words (runs of letters, digits and non-ASCII signs) divided by single blanks,
with a blank at either end; a rule applies where its keyword, a plain string,
occurs, and matches whole words. Sections have falling priority.
"""

from __future__ import annotations

#: Tags and addresses that name one licence and version.
EXACT = """
apache-2.0 | apache org licenses license 2 | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1.1 | apache org licenses license 1 | (?:www )?apache org licenses license 1 1(?: txt)?
mit | opensource org license | opensource org licenses? mit(?: license)?(?: php| html)?
bsd-3-clause | opensource org license | opensource org licenses? bsd 3 clause
bsd-2-clause | opensource org license | opensource org licenses? bsd 2 clause
isc | opensource org license | opensource org licenses? isc(?: license)?(?: txt)?
zlib | opensource org license | opensource org licenses? zlib(?: license)?(?: php)?
artistic-2.0 | opensource org license | opensource org licenses? artistic(?: license)? 2 0
mpl-2.0 | opensource org license | opensource org licenses? mpl 2 0
epl-1.0 | opensource org license | opensource org licenses? epl 1 0
epl-2.0 | opensource org license | opensource org licenses? epl 2 0
cddl-1.0 | opensource org license | opensource org licenses? cddl 1(?: 0)?
afl-3.0 | opensource org license | opensource org licenses? afl 3 0(?: php)?
osl-3.0 | opensource org license | opensource org licenses? osl 3 0(?: php)?
ms-pl | opensource org license | opensource org licenses? ms pl(?: html)?
ms-rl | opensource org license | opensource org licenses? ms rl
eupl-1.2 | opensource org license | opensource org licenses? eupl 1 2
upl-1.0 | opensource org license | opensource org licenses? upl
ncsa | opensource org license | opensource org licenses? (?:uoi )?ncsa(?: php)?
postgresql | opensource org license | opensource org licenses? postgresql
gpl-3.0 | gnu org licenses | (?:www )?gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
gpl-2.0 | gnu org licenses | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-1.0 | gnu org licenses | (?:www )?gnu org licenses (?:old licenses )?gpl 1 0(?: html| txt)?
gpl | gnu org licenses | (?:www )?gnu org licenses gpl(?: html)?
lgpl-3.0 | gnu org licenses | (?:www )?gnu org licenses lgpl 3 0(?: html| txt)?
lgpl-2.1 | gnu org licenses | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-2.0 | gnu org licenses | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 0(?: html| txt)?
lgpl | gnu org licenses | (?:www )?gnu org licenses lgpl(?: html)?
agpl-3.0 | gnu org licenses | (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gfdl-1.3 | gnu org licenses | (?:www )?gnu org licenses fdl 1 3(?: html| txt)?
gfdl | gnu org licenses | (?:www )?gnu org (?:licenses|copyleft) fdl(?: html)?
mpl-2.0 | mozilla org license | (?:www )?mozilla org licenses? mpl 2 0(?: txt)?
epl-2.0 | eclipse org legal epl | eclipse org legal epl (?:v 2 0|2 0|v20)(?: license)?(?: html)?
boost-1.0 | boost org license | (?:www )?boost org license 1 0(?: txt)?
unlicense | unlicense org | unlicense org(?: unlicense)?
openssl | openssl org source license | (?:www )?openssl org source license(?: html)?
python-2.0 | python org psf license | (?:www )?python org psf license
odbl-1.0 | opendatacommons org licenses odbl | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | opendatacommons org licenses by | opendatacommons org licenses by(?: 1 0)?
pddl-1.0 | opendatacommons org licenses pddl | opendatacommons org licenses pddl(?: 1 0)?
ofl-1.1 | scripts sil org ofl license | scripts sil org ofl license
cc-by-4.0 | creativecommons org licenses | creativecommons org licenses by 4 0(?: legalcode| deed)?
cc-by-3.0 | creativecommons org licenses | creativecommons org licenses by 3 0(?: legalcode| deed)?
cc-by-2.5 | creativecommons org licenses | creativecommons org licenses by 2 5
cc-by-2.0 | creativecommons org licenses | creativecommons org licenses by 2 0
cc-by-sa-4.0 | creativecommons org licenses | creativecommons org licenses by sa 4 0(?: legalcode| deed)?
cc-by-sa-3.0 | creativecommons org licenses | creativecommons org licenses by sa 3 0(?: legalcode| deed)?
cc-by-sa-2.5 | creativecommons org licenses | creativecommons org licenses by sa 2 5
cc-by-sa-2.0 | creativecommons org licenses | creativecommons org licenses by sa 2 0
cc-by-nc-4.0 | creativecommons org licenses | creativecommons org licenses by nc 4 0(?: legalcode| deed)?
cc-by-nc-3.0 | creativecommons org licenses | creativecommons org licenses by nc 3 0(?: legalcode| deed)?
cc-by-nd-4.0 | creativecommons org licenses | creativecommons org licenses by nd 4 0(?: legalcode| deed)?
cc-by-nd-3.0 | creativecommons org licenses | creativecommons org licenses by nd 3 0(?: legalcode| deed)?
cc-by-nc-sa-4.0 | creativecommons org licenses | creativecommons org licenses by nc sa 4 0(?: legalcode| deed)?
cc-by-nc-sa-3.0 | creativecommons org licenses | creativecommons org licenses by nc sa 3 0(?: legalcode| deed)?
cc-by-nc-nd-4.0 | creativecommons org licenses | creativecommons org licenses by nc nd 4 0(?: legalcode| deed)?
cc-by-nc-nd-3.0 | creativecommons org licenses | creativecommons org licenses by nc nd 3 0(?: legalcode| deed)?
cc0-1.0 | creativecommons org publicdomain | creativecommons org publicdomain zero 1 0(?: legalcode| deed)?
public-domain | creativecommons org publicdomain | creativecommons org publicdomain mark 1 0
mit | spdx | spdx license identifier mit
mit-0 | spdx | spdx license identifier mit 0
apache-2.0 | spdx | spdx license identifier apache 2 0
apache-1.1 | spdx | spdx license identifier apache 1 1
gpl-2.0 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.0 | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
bsd-2-clause | spdx | spdx license identifier bsd 2 clause(?: patent)?
bsd-3-clause | spdx | spdx license identifier bsd 3 clause(?: clear)?
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
isc | spdx | spdx license identifier isc
zlib | spdx | spdx license identifier zlib
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | spdx | spdx license identifier mpl 2 0
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
cddl-1.0 | spdx | spdx license identifier cddl 1 0
boost-1.0 | spdx | spdx license identifier bsl 1 0
busl-1.1 | spdx | spdx license identifier busl 1 1
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
ofl-1.1 | spdx | spdx license identifier ofl 1 1
artistic-2.0 | spdx | spdx license identifier artistic 2 0
postgresql | spdx | spdx license identifier postgresql
ncsa | spdx | spdx license identifier ncsa
eupl-1.2 | spdx | spdx license identifier eupl 1 2
python-2.0 | spdx | spdx license identifier (?:psf|python) 2 0
elastic-2.0 | spdx | spdx license identifier elastic 2 0
sspl-1.0 | spdx | spdx license identifier sspl 1 0
"""

#: Names with a version, and sentences of a licence's own text.
NAMED = """
apache-2.0 | apache license | (?:the )?apache (?:software )?license,? ?(?:version|v|ver)? ?2(?: 0)?
apache-1.1 | apache software license | apache software license (?:version|v)? ?1 1
apache-1.0 | apache license | apache license (?:version|v)? ?1 0
apache-2.0 | licensed under the apache 2 | licensed under (?:the )?apache 2(?: 0)?
gpl-3.0 | general public license | (?:gnu )?general public license,? (?:as published by the free software foundation )?(?:either )?(?:version|v|ver) ?3(?: 0)?(?: or later)?
gpl-2.0 | general public license | (?:gnu )?general public license,? (?:as published by the free software foundation )?(?:either )?(?:version|v|ver) ?2(?: 0)?(?: or later)?
gpl-1.0 | general public license | (?:gnu )?general public license (?:either )?(?:version|v|ver) ?1(?: 0)?
gpl-3.0 | gplv3 license | gplv3 license
gpl-2.0 | gplv2 license | gplv2 license
gpl-3.0 | gnu gpl | gnu gpl (?:version|v)? ?3(?: 0)?
gpl-2.0 | gnu gpl | gnu gpl (?:version|v)? ?2(?: 0)?
lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license (?:either )?(?:version|v|ver) ?3(?: 0)?(?: or later)?
lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license (?:either )?(?:version|v|ver) ?2 1(?: or later)?
lgpl-2.0 | library general public license | (?:gnu )?library general public license (?:either )?(?:version|v|ver) ?2(?: 0)?
lgpl-3.0 | gnu lgpl | gnu lgpl (?:version|v)? ?3(?: 0)?
lgpl-2.1 | gnu lgpl | gnu lgpl (?:version|v)? ?2 1
agpl-3.0 | affero general public license | (?:gnu )?affero general public license(?: (?:either )?(?:version|v|ver) ?3(?: 0)?)?
agpl-1.0 | affero general public license | affero general public license (?:version|v) ?1(?: 0)?
gfdl-1.3 | free documentation license | (?:gnu )?free documentation license (?:version|v) ?1 3
gfdl-1.2 | free documentation license | (?:gnu )?free documentation license (?:version|v) ?1 2
gfdl-1.1 | free documentation license | (?:gnu )?free documentation license (?:version|v) ?1 1
mpl-2.0 | mozilla public license | mozilla public license,? (?:version|v)? ?2(?: 0)?
mpl-1.1 | mozilla public license | mozilla public license (?:version|v)? ?1 1
mpl-1.0 | mozilla public license | mozilla public license (?:version|v)? ?1 0
epl-2.0 | eclipse public license | eclipse public license (?:version|v)? ?2(?: 0)?
epl-1.0 | eclipse public license | eclipse public license (?:version|v)? ?1 0
edl-1.0 | eclipse distribution license | eclipse distribution license(?: (?:version|v)? ?1 0)?
cddl-1.1 | common development and distribution license | common development and distribution license (?:version|v)? ?1 1
cddl-1.0 | common development and distribution license | common development and distribution license(?: (?:version|v)? ?1 0)?
cpl-1.0 | common public license | common public license (?:version|v)? ?1 0
ipl-1.0 | ibm public license | ibm public license(?: (?:version|v)? ?1 0)?
bsd-3-clause | bsd 3 clause license | bsd 3 clause(?: new| modified)?(?: or)? license
bsd-3-clause | 3 clause bsd license | (?:the )?3 clause bsd license
bsd-3-clause | new bsd license | (?:the )?new bsd license
bsd-3-clause | modified bsd license | modified bsd license
bsd-2-clause | bsd 2 clause license | bsd 2 clause license
bsd-2-clause | 2 clause bsd license | (?:the )?2 clause bsd license
bsd-2-clause | simplified bsd license | simplified bsd license
bsd-2-clause | freebsd license | freebsd license
bsd-4-clause | original bsd license | original bsd license
bsd-4-clause | 4 clause bsd license | (?:the )?4 clause bsd license
0bsd | zero clause bsd license | (?:bsd )?zero clause bsd license
mit | mit x11 license | mit x11 license
mit | expat license | expat license
mit | the mit license mit | the mit license mit
mit-0 | mit no attribution license | mit no attribution license
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | to endorse or promote products | neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products
boost-1.0 | boost software license | boost software license(?: (?:version|v)? ?1 0)?
artistic-2.0 | artistic license | artistic license (?:version|v)? ?2(?: 0)?
artistic-1.0 | artistic license | artistic license (?:version|v)? ?1 0
afl-3.0 | academic free license | academic free license (?:version|v)? ?3(?: 0)?
afl-2.1 | academic free license | academic free license (?:version|v)? ?2 1
osl-3.0 | open software license | open software license (?:version|v)? ?3(?: 0)?
eupl-1.2 | european union public licen | european union public licen[cs]e (?:version|v)? ?1 2
eupl-1.1 | european union public licen | european union public licen[cs]e (?:version|v)? ?1 1
cecill-2.1 | cecill | cecill (?:free software )?licen[cs]e(?: agreement)? (?:version|v)? ?2 1
ofl-1.1 | open font license | (?:sil )?open font license(?: (?:version|v)? ?1 1)?
lppl-1.3c | latex project public license | latex project public license (?:version|v)? ?1 3c?
php-3.01 | php license | php license (?:version|v)? ?3 01
python-2.0 | python software foundation license | python software foundation license(?: (?:version|v)? ?2)?
zpl-2.1 | zope public license | zope public license (?:version|v)? ?2 1
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
apsl-2.0 | apple public source license | apple public source license(?: (?:version|v)? ?2 0)?
sspl-1.0 | server side public license | server side public license(?: (?:version|v)? ?1)?
busl-1.1 | business source license | business source license(?: (?:version|v)? ?1 1)?
elastic-2.0 | elastic license | elastic license (?:version|v)? ?2(?: 0)?
llama-3 | llama 3 community license | (?:meta )?llama 3(?: [0-9])? community license(?: agreement)?
llama-2 | llama 2 community license | llama 2 community license(?: agreement)?
openrail | responsible ai license | (?:open )?responsible ai license
odbl-1.0 | open database license | (?:odc )?open database license(?: odbl)?(?: v?1 0)?
odc-by-1.0 | open data commons attribution license | open data commons attribution license(?: v?1 0)?
pddl-1.0 | public domain dedication and license | (?:odc |open data commons )?public domain dedication and license
ogl-uk-3.0 | open government licen | open government licen[cs]e (?:version|v)? ?3(?: 0)?
ogl-uk-2.0 | open government licen | open government licen[cs]e (?:version|v)? ?2(?: 0)?
cc-by-4.0 | commons attribution 4 0 | creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
cc-by-3.0 | commons attribution 3 0 | creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa-4.0 | commons attribution sharealike 4 0 | creative commons attribution sharealike 4 0(?: international)?(?: license)?
cc-by-sa-3.0 | commons attribution sharealike 3 0 | creative commons attribution sharealike 3 0(?: unported)?(?: license)?
cc-by-sa-3.0 | commons attribution share alike 3 0 | creative commons attribution share alike 3 0(?: unported)?(?: license)?
cc-by-nc-4.0 | commons attribution noncommercial 4 0 | creative commons attribution noncommercial 4 0(?: international)?(?: license)?
cc-by-nc-3.0 | commons attribution noncommercial 3 0 | creative commons attribution noncommercial 3 0(?: unported)?(?: license)?
cc-by-nc-sa-4.0 | commons attribution noncommercial sharealike 4 0 | creative commons attribution noncommercial sharealike 4 0(?: international)?(?: license)?
cc-by-nc-nd-4.0 | commons attribution noncommercial noderiv | creative commons attribution noncommercial noderiv(?:ative)?s 4 0(?: international)?(?: license)?
cc-by-nd-4.0 | commons attribution noderiv | creative commons attribution noderiv(?:ative)?s 4 0(?: international)?(?: license)?
cc-by-4.0 | cc by 4 0 | cc by 4 0
cc-by-3.0 | cc by 3 0 | cc by 3 0
cc-by-2.0 | cc by 2 0 | cc by 2 0
cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0
cc-by-sa-3.0 | cc by sa 3 0 | cc by sa 3 0
cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0
cc-by-nc-3.0 | cc by nc 3 0 | cc by nc 3 0
cc-by-nd-4.0 | cc by nd 4 0 | cc by nd 4 0
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc by nc nd 3 0 | cc by nc nd 3 0
cc0-1.0 | cc0 1 0 | cc0 1 0(?: universal)?
unlicense | this is free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | do what the fuck you want to public license | do what the fuck you want to public license
"""

#: Names alone.
FAMILY = """
mit | mit license | (?:the )?mit license
mit | mit licence | (?:the )?mit licence
mit | mit licensed | mit licensed
apache | apache license | (?:the )?apache (?:software )?license
apache | apache licence | (?:the )?apache licence
apache | apache software license | apache software license
gpl | general public license | (?:gnu )?general public license
gpl | general public licence | (?:gnu )?general public licence
gpl | gnu gpl | (?:the )?gnu gpl
gpl | gpl license | gpl licen[cs]ed?
lgpl | lesser general public license | (?:gnu )?lesser general public license
lgpl | library general public license | (?:gnu )?library general public license
lgpl | gnu lgpl | (?:the )?gnu lgpl
lgpl | lgpl license | lgpl licen[cs]ed?
agpl | gnu agpl | (?:the )?gnu agpl
agpl | agpl license | agpl licen[cs]ed?
gfdl | free documentation license | (?:gnu )?free documentation license
bsd | bsd license | (?:the )?bsd licen[cs]e
bsd | bsd style license | bsd style license
bsd | bsd licensed | bsd licensed
isc | isc license | (?:the )?isc license
zlib | zlib license | zlib(?: libpng)? license
mpl | mozilla public license | mozilla public license
epl | eclipse public license | eclipse public license
cpl | common public license | common public license
artistic | artistic license | artistic license
afl | academic free license | academic free license
osl | open software license | open software license
eupl | european union public licen | european union public licen[cs]e
cecill | cecill license | cecill licen[cs]e
lppl | latex project public license | latex project public license
php | php license | php license
psf | psf license | psf license
zpl | zope public license | zope public license
openssl | openssl license | openssl license
ncsa | ncsa open source license | (?:university of illinois )?ncsa open source license
postgresql | postgresql license | postgresql license
w3c | w3c software license | w3c software(?: notice and)? license
x11 | x11 license | x11 license
vim | vim license | vim license
ruby | ruby license | ruby license
beerware | beerware license | beerware license
elastic | elastic license | elastic license
sleepycat | sleepycat license | sleepycat license
naist | naist license | naist license
unicode | unicode license | unicode license(?: agreement)?
ogl | open government licen | open government licen[cs]e
cc-by | cc by | cc by
cc-by-sa | cc by sa | cc by sa
cc-by-nc | cc by nc | cc by nc
cc-by-nd | cc by nd | cc by nd
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc0 | cc0 | cc0
cc | creative commons | creative commons(?: attribution)?(?: noncommercial)?(?: sharealike| noderiv(?:ative)?s)?(?: license)?
unlicense | unlicense | (?:the )?unlicense
public-domain | public domain | (?:released |placed |dedicated )?(?:in|into|to) the public domain
public-domain | public domain dedication | public domain dedication
"""

#: Signs of terms that name no licence.
GENERIC = """
proprietary | all rights reserved | all rights reserved
proprietary | proprietary license | proprietary licen[cs]e
commercial | commercial license | commercial licen[cs]e(?: agreement)?
eula | end user license agreement | end user licen[cs]e agreement
shareware | shareware license | shareware licen[cs]e
copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])*
copyleft | copyleft | copyleft
dual-license | dual license | dual licen[cs]ed?
license-notice | licensed under | (?:is |are )?licen[cs]ed under
license-notice | released under the | released under the (?:terms of )?
license-notice | under the terms of the license | under the terms of the licen[cs]e
license-notice | see license | see licen[cs]e(?: txt| md| file)?
warranty-disclaimer | without warranty of any kind | (?:is provided as is )?without warranty of any kind
warranty-disclaimer | without any warranty | without any warranty
"""

#: Every keyword holds one of these, so a text without them has no detection.
GATE = r"(?i)licen|copyright|copyleft|spdx|gnu|domain|reserved|commons|cc0|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by|warrant|granted|redistribution|permission|endorse|cecill|released|epl|unencumbered"
SECTIONS = ((4, EXACT), (3, NAMED), (2, FAMILY), (1, GENERIC))


def rules() -> list[tuple[str, int, str, str]]:
    """label, priority, keyword, regex; the regex looks for whole words."""
    out = []
    for priority, section in SECTIONS:
        for line in section.strip().splitlines():
            label, keyword, regex = (x.strip() for x in line.split("|", 2))
            out.append((label, priority, f" {keyword}", f"(?<= )(?:{regex.strip()})(?= )"))
    return out
