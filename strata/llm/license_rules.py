"""Signatures of licences, in order: licence, priority, keyword and regular expression of each.

The text is in lower case with every run of white space as one space. A keyword is a string that is in every match of its expression.
"""

from __future__ import annotations

_TEXT = r"""
Apache-2.0 | 90 | apache license | licensed under the apache license,? version 2(?:\.0)?\b
Apache-2.0 | 80 | apache license | apache license,? ?(?:version|v\.?) ?2(?:\.0)?\b
Apache-2.0 | 80 | apache-2 | \bapache-2(?:\.0)?\b
Apache-2.0 | 80 | apache 2 | \bapache 2(?:\.0)?(?: licen[cs]e)?\b
Apache-2.0 | 90 | apache.org/licenses/license-2.0 | https?://www\.apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-2.0 | 70 | asl 2 | \basl 2\.0\b
Apache-1.1 | 80 | apache | apache (?:software )?license,? ?(?:version|v) ?1\.1\b
Apache-1.0 | 80 | apache | apache (?:software )?license,? ?(?:version|v) ?1\.0\b
Apache-1.1 | 80 | apache-1.1 | \bapache-1\.1\b
Apache-1.0 | 80 | apache-1.0 | \bapache-1\.0\b
Apache | 40 | apache license | \bapache (?:software )?license\b
Apache | 40 | apache software license | \bapache software license\b
MIT | 90 | mit license | (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit license
MIT | 70 | mit license | \b(?:the )?mit license\b
MIT | 70 | mit licence | \b(?:the )?mit licence\b
MIT | 70 | mit-license | \bmit-licensed?\b
MIT | 95 | permission is hereby granted, free of charge | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT | 80 | opensource.org/licenses/mit | https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license(?:\.php)?)?
MIT-0 | 95 | mit-0 | \bmit-0\b
MIT-0 | 95 | mit no attribution | \bmit no attribution\b
X11 | 70 | x11 license | \bx11 license\b
Expat | 60 | expat license | \bexpat license\b
MIT-CMU | 70 | mit-cmu | \bmit-cmu\b
MIT-advertising | 70 | mit-advertising | \bmit-advertising\b
ISC | 95 | permission to use, copy, modify, and/or distribute this software | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
ISC | 70 | isc license | \b(?:the )?isc license\b
ISC | 70 | isc licence | \b(?:the )?isc licence\b
0BSD | 96 | 0bsd | \b0bsd\b
0BSD | 85 | zero-clause bsd | \bzero-clause bsd\b
0BSD | 85 | zero clause | \bbsd zero clause\b|\bzero clause bsd\b
BSD-4-Clause | 85 | bsd-4-clause | \bbsd-4-clause(?:-uc)?\b
BSD-4-Clause | 85 | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display
BSD-4-Clause | 85 | original bsd | \boriginal bsd license\b
BSD-3-Clause | 85 | bsd-3-clause | \bbsd-3-clause(?:-clear|-attribution|-lbnl)?\b
BSD-3-Clause | 80 | 3-clause bsd | \b3-clause bsd(?: licen[cs]e)?\b
BSD-3-Clause | 80 | three-clause bsd | \bthree-clause bsd(?: licen[cs]e)?\b
BSD-3-Clause | 80 | new bsd | \bnew bsd licen[cs]e\b
BSD-3-Clause | 80 | modified bsd | \bmodified bsd licen[cs]e\b
BSD-3-Clause | 80 | revised bsd | \brevised bsd licen[cs]e\b
BSD-3-Clause | 85 | endorse or promote products derived | neither the name of .{1,120}? may be used to endorse or promote products derived
BSD-3-Clause | 80 | licenses/bsd-3-clause | https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause
BSD-2-Clause | 85 | bsd-2-clause | \bbsd-2-clause(?:-patent|-views|-freebsd|-netbsd)?\b
BSD-2-Clause | 80 | 2-clause bsd | \b2-clause bsd(?: licen[cs]e)?\b
BSD-2-Clause | 80 | two-clause bsd | \btwo-clause bsd(?: licen[cs]e)?\b
BSD-2-Clause | 80 | simplified bsd | \bsimplified bsd licen[cs]e\b
BSD-2-Clause | 80 | freebsd license | \bfreebsd license\b
BSD | 50 | redistribution and use in source and binary forms | redistribution and use in source and binary forms,? with or without modification,? (?:are|is) permitted
BSD | 30 | bsd license | \bbsd license\b
BSD | 30 | bsd licence | \bbsd licence\b
BSD | 30 | bsd-style | \bbsd-style licen[cs]e\b
AGPL-3.0-or-later | 95 | agpl-3.0-or-later | \bagpl-3\.0-or-later\b
AGPL-3.0-only | 94 | agpl-3.0 | \bagpl-3\.0(?:-only)?\b
AGPL-3.0-or-later | 95 | gnu affero general public license | gnu affero general public license,? (?:version 3(?:\.0)? )?(?:as published by the free software foundation,? )?(?:either version 3|version 3(?:\.0)?,? or) .{0,40}?any later version
AGPL-3.0-only | 90 | gnu affero general public license | gnu affero general public license,? (?:version|v) ?3(?:\.0)?
AGPL | 60 | affero general public license | (?:gnu )?affero general public license
AGPL | 55 | agplv3 | \bagplv3\+?
AGPL-1.0 | 80 | agpl-1.0 | \bagpl-1\.0(?:-only|-or-later)?\b
LGPL-3.0-or-later | 95 | lgpl-3.0 | \blgpl-3\.0(?:-or-later|\+)
LGPL-3.0-only | 90 | lgpl-3.0 | \blgpl-3\.0(?:-only)?\b
LGPL-2.1-or-later | 95 | lgpl-2.1 | \blgpl-2\.1(?:-or-later|\+)
LGPL-2.1-only | 90 | lgpl-2.1 | \blgpl-2\.1(?:-only)?\b
LGPL-2.0-or-later | 95 | lgpl-2.0 | \blgpl-2\.0(?:-or-later|\+)
LGPL-2.0-only | 90 | lgpl-2.0 | \blgpl-2\.0(?:-only)?\b
LGPL-3.0-only | 90 | gnu lesser general public license | gnu lesser general public license,? (?:version|v) ?3(?:\.0)?
LGPL-2.1-only | 90 | gnu lesser general public license | gnu lesser general public license,? (?:version|v) ?2\.1
LGPL-2.0-only | 90 | gnu library general public license | gnu library general public license,? (?:version|v) ?2(?:\.0)?
LGPL-3.0-only | 70 | lgplv3 | \blgplv3\+?
LGPL-2.1-only | 70 | lgplv2 | \blgplv2(?:\.1)?\+?
LGPL | 60 | gnu lesser general public license | gnu lesser general public license
LGPL | 60 | gnu library general public license | gnu library general public license
LGPL | 30 | lgpl | \blgpl\b
GPL-3.0-or-later | 95 | gpl-3.0 | \bgpl-3\.0(?:-or-later|\+)
GPL-3.0-only | 90 | gpl-3.0 | \bgpl-3\.0(?:-only)?\b
GPL-2.0-or-later | 95 | gpl-2.0 | \bgpl-2\.0(?:-or-later|\+)
GPL-2.0-only | 90 | gpl-2.0 | \bgpl-2\.0(?:-only)?\b
GPL-1.0-or-later | 95 | gpl-1.0 | \bgpl-1\.0(?:-or-later|\+)
GPL-1.0-only | 90 | gpl-1.0 | \bgpl-1\.0(?:-only)?\b
GPL-3.0-or-later | 97 | any later version | gnu general public license .{0,120}?version 3(?:\.0)?,? (?:of the license, )?or \(?at your option\)? any later version
GPL-2.0-or-later | 97 | any later version | gnu general public license .{0,120}?version 2(?:\.0)?,? (?:of the license, )?or \(?at your option\)? any later version
GPL-3.0-only | 92 | gnu general public license | licensed under (?:the )?(?:terms of the )?gnu general public license,? version 3(?:\.0)?
GPL-2.0-only | 92 | gnu general public license | licensed under (?:the )?(?:terms of the )?gnu general public license,? version 2(?:\.0)?
GPL-3.0-only | 88 | gnu general public license | gnu general public license,? (?:version|v\.?) ?3(?:\.0)?
GPL-2.0-only | 88 | gnu general public license | gnu general public license,? (?:version|v\.?) ?2(?:\.0)?
GPL-1.0-only | 88 | gnu general public license | gnu general public license,? (?:version|v\.?) ?1(?:\.0)?
GPL-3.0-only | 70 | gplv3 | \bgplv3\+?
GPL-2.0-only | 70 | gplv2 | \bgplv2\+?
GPL-3.0-only | 70 | gnu gpl | \bgnu gpl,? ?(?:version|v) ?3\b
GPL-2.0-only | 70 | gnu gpl | \bgnu gpl,? ?(?:version|v) ?2\b
GPL | 50 | gnu general public license | gnu general public license
GPL | 60 | gnu.org/licenses | https?://www\.gnu\.org/licenses/(?:old-licenses/)?gpl[-.0-9a-z]*
LGPL | 62 | gnu.org/licenses | https?://www\.gnu\.org/licenses/(?:old-licenses/)?lgpl[-.0-9a-z]*
AGPL | 64 | gnu.org/licenses | https?://www\.gnu\.org/licenses/(?:old-licenses/)?agpl[-.0-9a-z]*
GPL | 25 | gnu gpl | \bgnu gpl\b
GPL-classpath-exception | 75 | classpath exception | \bclasspath exception\b
GFDL-1.3 | 85 | gfdl-1.3 | \bgfdl-1\.3(?:-only|-or-later)?\b
GFDL-1.2 | 85 | gfdl-1.2 | \bgfdl-1\.2(?:-only|-or-later)?\b
GFDL-1.1 | 85 | gfdl-1.1 | \bgfdl-1\.1(?:-only|-or-later)?\b
GFDL | 60 | gnu free documentation license | gnu free documentation license
MPL-2.0 | 92 | mozilla public license | subject to the terms of the mozilla public license,? v\. ?2\.0
MPL-2.0 | 88 | mozilla public license | mozilla public license,? (?:version|v\.?) ?2(?:\.0)?
MPL-1.1 | 88 | mozilla public license | mozilla public license,? (?:version|v\.?) ?1\.1
MPL-1.0 | 88 | mozilla public license | mozilla public license,? (?:version|v\.?) ?1\.0
MPL-2.0 | 88 | mpl-2.0 | \bmpl-2\.0(?:-no-copyleft-exception)?\b
MPL-1.1 | 88 | mpl-1.1 | \bmpl-1\.1\b
MPL-1.0 | 88 | mpl-1.0 | \bmpl-1\.0\b
MPL-2.0 | 80 | mozilla.org/mpl/2.0 | https?://(?:www\.)?mozilla\.org/mpl/2\.0
MPL | 50 | mozilla public license | mozilla public license
NPL-1.1 | 70 | netscape public license | netscape public license(?:,? (?:version|v) ?1\.1)?
EPL-2.0 | 88 | eclipse public license | eclipse public license,? ?(?:-|version|v\.?)? ?2(?:\.0)?
EPL-1.0 | 88 | eclipse public license | eclipse public license,? ?(?:-|version|v\.?)? ?1(?:\.0)?
EPL-2.0 | 88 | epl-2.0 | \bepl-2\.0\b
EPL-1.0 | 88 | epl-1.0 | \bepl-1\.0\b
EPL | 50 | eclipse public license | eclipse public license
EDL-1.0 | 70 | eclipse distribution license | eclipse distribution license
CDDL-1.1 | 88 | common development and distribution license | common development and distribution license.{0,20}?1\.1
CDDL-1.0 | 86 | common development and distribution license | common development and distribution license.{0,20}?1\.0
CDDL-1.0 | 88 | cddl-1.0 | \bcddl-1\.0\b
CDDL-1.1 | 88 | cddl-1.1 | \bcddl-1\.1\b
CDDL | 50 | common development and distribution license | common development and distribution license
CPL-1.0 | 80 | common public license | common public license
CPAL-1.0 | 80 | common public attribution license | common public attribution license
CPAL-1.0 | 80 | cpal-1.0 | \bcpal-1\.0\b
EUPL-1.2 | 88 | eupl-1.2 | \beupl-1\.2\b
EUPL-1.1 | 88 | eupl-1.1 | \beupl-1\.1\b
EUPL-1.0 | 88 | eupl-1.0 | \beupl-1\.0\b
EUPL | 50 | european union public licen | european union public licen[cs]e
CC-BY-NC-SA-4.0 | 92 | cc by-nc-sa | \bcc by-nc-sa 4\.0\b
CC-BY-NC-ND-4.0 | 92 | cc by-nc-nd | \bcc by-nc-nd 4\.0\b
CC-BY-NC-4.0 | 92 | cc by-nc | licensed under (?:a |the )?cc by-nc 4\.0\b
CC-BY-NC-4.0 | 90 | cc by-nc | \bcc by-nc 4\.0\b
CC-BY-SA-4.0 | 90 | cc by-sa | \bcc by-sa 4\.0\b
CC-BY-ND-4.0 | 90 | cc by-nd | \bcc by-nd 4\.0\b
CC-BY-4.0 | 90 | cc by | \bcc by 4\.0\b
CC-BY-NC-SA-3.0 | 92 | cc by-nc-sa | \bcc by-nc-sa 3\.0\b
CC-BY-NC-ND-3.0 | 92 | cc by-nc-nd | \bcc by-nc-nd 3\.0\b
CC-BY-NC-3.0 | 90 | cc by-nc | \bcc by-nc 3\.0\b
CC-BY-SA-3.0 | 90 | cc by-sa | \bcc by-sa 3\.0\b
CC-BY-ND-3.0 | 90 | cc by-nd | \bcc by-nd 3\.0\b
CC-BY-3.0 | 90 | cc by | \bcc by 3\.0\b
CC-BY-NC-SA | 60 | cc by-nc-sa | \bcc by-nc-sa\b
CC-BY-NC-ND | 60 | cc by-nc-nd | \bcc by-nc-nd\b
CC-BY-NC | 55 | cc by-nc | \bcc by-nc\b
CC-BY-SA | 55 | cc by-sa | \bcc by-sa\b
CC-BY-ND | 55 | cc by-nd | \bcc by-nd\b
CC-BY-NC-SA | 88 | cc-by-nc-sa | \bcc-by-nc-sa(?:-[1-4]\.[05])?\b
CC-BY-NC-ND | 88 | cc-by-nc-nd | \bcc-by-nc-nd(?:-[1-4]\.[05])?\b
CC-BY-NC | 80 | cc-by-nc | \bcc-by-nc(?:-[1-4]\.[05])?\b
CC-BY-SA | 80 | cc-by-sa | \bcc-by-sa(?:-[1-4]\.[05])?\b
CC-BY-ND | 80 | cc-by-nd | \bcc-by-nd(?:-[1-4]\.[05])?\b
CC-BY | 70 | cc-by | \bcc-by(?:-[1-4]\.[05])?\b
CC-BY-NC-SA | 85 | attribution-noncommercial-sharealike | creative commons attribution-noncommercial-sharealike(?: [1-4]\.[05])?
CC-BY-NC-ND | 85 | attribution-noncommercial-noderiv | creative commons attribution-noncommercial-noderiv(?:s|atives)(?: [1-4]\.[05])?
CC-BY-NC | 80 | attribution-noncommercial | creative commons attribution-noncommercial(?: [1-4]\.[05])?
CC-BY-SA | 80 | attribution-sharealike | creative commons attribution-sharealike(?: [1-4]\.[05])?
CC-BY-ND | 80 | attribution-noderiv | creative commons attribution-noderiv(?:s|atives)(?: [1-4]\.[05])?
CC-BY | 70 | creative commons attribution | creative commons attribution(?: [1-4]\.[05])?
CC0-1.0 | 90 | cc0 | \bcc0(?:[- ]1\.0)?(?: universal)?\b
CC0-1.0 | 85 | creative commons zero | creative commons zero(?: v?1\.0)?(?: universal)?
CC-BY-NC-SA | 87 | creativecommons.org/licenses/by-nc-sa | https?://creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]/?
CC-BY-NC-ND | 87 | creativecommons.org/licenses/by-nc-nd | https?://creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]/?
CC-BY-NC | 87 | creativecommons.org/licenses/by-nc/ | https?://creativecommons\.org/licenses/by-nc/[1-4]\.[05]/?
CC-BY-SA | 87 | creativecommons.org/licenses/by-sa/ | https?://creativecommons\.org/licenses/by-sa/[1-4]\.[05]/?
CC-BY-ND | 87 | creativecommons.org/licenses/by-nd/ | https?://creativecommons\.org/licenses/by-nd/[1-4]\.[05]/?
CC-BY | 87 | creativecommons.org/licenses/by/ | https?://creativecommons\.org/licenses/by/[1-4]\.[05]/?
CC0-1.0 | 87 | creativecommons.org/publicdomain/zero | https?://creativecommons\.org/publicdomain/zero/1\.0/?
CC | 30 | creative commons | \bcreative commons licen[cs]e\b
CC-PDDC | 70 | cc-pddc | \bcc-pddc\b
PDDL-1.0 | 80 | public domain dedication and license | open data commons public domain dedication and license
ODbL-1.0 | 85 | open database license | (?:odc )?open database license(?: \(?odbl\)?)?(?: v?1\.0)?
ODbL-1.0 | 85 | odbl | \bodbl(?:-1\.0| v?1\.0)?\b
ODC-By-1.0 | 85 | odc-by | \bodc-by(?:-1\.0)?\b
ODC-By-1.0 | 80 | open data commons attribution | open data commons attribution licen[cs]e
CDLA-Permissive-2.0 | 88 | cdla-permissive-2.0 | \bcdla-permissive-2\.0\b
CDLA-Permissive-1.0 | 88 | cdla-permissive-1.0 | \bcdla-permissive-1\.0\b
CDLA-Sharing-1.0 | 88 | cdla-sharing-1.0 | \bcdla-sharing-1\.0\b
CDLA | 60 | community data license agreement | community data license agreement
OGL-UK-3.0 | 80 | open government licen | open government licen[cs]e,? ?(?:version|v)? ?3\.0
OGL-UK-2.0 | 80 | open government licen | open government licen[cs]e,? ?(?:version|v)? ?2\.0
OGL-UK-1.0 | 80 | open government licen | open government licen[cs]e,? ?(?:version|v)? ?1\.0
OGL | 50 | open government licen | open government licen[cs]e
Unlicense | 90 | free and unencumbered software | this is free and unencumbered software released into the public domain
Unlicense | 80 | the unlicense | \bthe unlicense\b
Unlicense | 80 | unlicense.org | https?://unlicense\.org/?
WTFPL | 90 | wtfpl | \bwtfpl\b
WTFPL | 90 | do what the fuck you want | do what the fuck you want to public license
Zlib | 90 | altered source versions must be plainly marked | altered source versions must be plainly marked as such
Zlib | 80 | zlib license | \bzlib license\b
Zlib | 80 | zlib/libpng | \bzlib/libpng licen[cs]e\b
Libpng | 80 | libpng license | \blibpng license\b
BSL-1.0 | 90 | boost software license | boost software license(?: -|,)? ?(?:version )?1\.0
BSL-1.0 | 85 | bsl-1.0 | \bbsl-1\.0\b
BSL-1.0 | 60 | boost software license | boost software license
BUSL-1.1 | 90 | busl-1.1 | \bbusl-1\.1\b
BUSL-1.1 | 85 | business source license | business source license(?:,? ?(?:version )?1\.1)?
SSPL-1.0 | 90 | sspl-1.0 | \bsspl-1\.0\b
SSPL-1.0 | 85 | server side public license | server side public license
Elastic-2.0 | 90 | elastic-2.0 | \belastic-2\.0\b
Elastic-2.0 | 85 | elastic license | elastic license(?: 2\.0)?
Commons-Clause | 80 | commons clause | \bcommons clause\b
PolyForm-Noncommercial-1.0.0 | 85 | polyform noncommercial | polyform noncommercial licen[cs]e
PolyForm-Small-Business-1.0.0 | 85 | polyform small business | polyform small business licen[cs]e
PolyForm-Strict | 85 | polyform strict | polyform strict licen[cs]e
Artistic-2.0 | 88 | artistic license | artistic license,? ?(?:version|v)? ?2(?:\.0)?
Artistic-2.0 | 88 | artistic-2.0 | \bartistic-2\.0\b
Artistic-1.0 | 88 | artistic-1.0 | \bartistic-1\.0(?:-perl|-cl8)?\b
Artistic-1.0 | 50 | artistic license | (?:the )?(?:perl )?artistic license
Perl | 60 | same terms as perl | under the same terms as perl(?: itself)?
Python-2.0 | 85 | python software foundation license | python software foundation license(?:,? ?version ?2)?
PSF-2.0 | 85 | psf-2.0 | \bpsf-2\.0\b
Python-2.0 | 85 | python-2.0 | \bpython-2\.0\b
CNRI-Python | 80 | cnri | \bcnri(?:-| open source )(?:python|license agreement)\b
PHP-3.01 | 88 | php license | php license,? ?(?:version|v) ?3\.01
PHP-3.0 | 86 | php license | php license,? ?(?:version|v) ?3\.0\b
PHP | 50 | php license | \bphp license\b
PHP-3.01 | 88 | php-3.01 | \bphp-3\.01\b
Ruby | 60 | ruby license | \bruby license\b
Ruby | 60 | ruby's licen | under ruby's licen[cs]e
OFL-1.1 | 90 | sil open font license | sil open font license,? ?(?:version|v)? ?1\.1
OFL-1.0 | 88 | sil open font license | sil open font license,? ?(?:version|v)? ?1\.0
OFL-1.1 | 88 | ofl-1.1 | \bofl-1\.1(?:-rfn|-no-rfn)?\b
OFL | 60 | open font license | (?:sil )?open font license
Bitstream-Vera | 70 | bitstream vera | bitstream vera (?:fonts? )?(?:copyright|license)
FTL | 70 | freetype project license | freetype project license
FTL | 70 | freetype license | \bfreetype license\b
IJG | 70 | independent jpeg group | this software is based in part on the work of the independent jpeg group
ICU | 70 | icu license | \bicu license\b
Unicode-DFS-2016 | 85 | unicode-dfs-2016 | \bunicode-dfs-201[56]\b
Unicode-3.0 | 80 | unicode license v3 | unicode license v3
Unicode-TOU | 70 | unicode terms of use | unicode terms of use
NCSA | 85 | illinois/ncsa open source license | university of illinois/ncsa open source license
NCSA | 70 | ncsa open source license | ncsa open source license
W3C | 80 | w3c software | w3c software (?:and document )?(?:notice and )?licen[cs]e
OpenSSL | 80 | openssl license | \bopenssl license\b
OpenSSL | 80 | openssl toolkit | developed by the openssl project for use in the openssl toolkit
SSLeay | 80 | ssleay | \bssleay licen[cs]e\b
curl | 70 | curl license | \bcurl license\b
PostgreSQL | 80 | postgresql license | \bpostgresql licen[cs]e\b
PostgreSQL | 80 | postgresql licence | \bpostgresql licence\b
Sleepycat | 80 | sleepycat | \bsleepycat (?:public )?licen[cs]e\b
QPL-1.0 | 80 | q public license | \bq public license(?:,? ?(?:version )?1\.0)?
QPL-1.0 | 80 | qpl-1.0 | \bqpl-1\.0\b
OSL-3.0 | 85 | osl-3.0 | \bosl-3\.0\b
OSL-3.0 | 80 | open software license | open software license(?:,? ?(?:version|v)?\.? ?3\.0)?
AFL-3.0 | 85 | afl-3.0 | \bafl-3\.0\b
AFL | 70 | academic free license | academic free license(?:,? ?(?:version|v)?\.? ?[123]\.[012])?
ECL-2.0 | 80 | educational community license | educational community license(?:,? ?(?:version )?2\.0)?
ECL-2.0 | 80 | ecl-2.0 | \becl-2\.0\b
RPL-1.5 | 80 | reciprocal public license | reciprocal public license(?: 1\.[15])?
RPSL-1.0 | 80 | realnetworks public source | realnetworks public source license
APSL-2.0 | 80 | apple public source license | apple public source license(?:,? ?(?:version )?[12]\.[0-2])?
MS-PL | 80 | microsoft public license | microsoft public license
MS-RL | 80 | microsoft reciprocal license | microsoft reciprocal license
MS-PL | 80 | ms-pl | \bms-pl\b
MS-RL | 80 | ms-rl | \bms-rl\b
IPL-1.0 | 80 | ibm public license | ibm public license(?:,? ?(?:version )?1\.0)?
SPL-1.0 | 80 | sun public license | sun public license
SISSL | 80 | sun industry standards source license | sun industry standards source license
LPL-1.02 | 80 | lucent public license | lucent public license(?: 1\.02)?
NPOSL-3.0 | 80 | nposl-3.0 | \bnposl-3\.0\b
Nokia | 80 | nokia open source license | nokia open source license
NASA-1.3 | 80 | nasa open source agreement | nasa open source agreement(?: 1\.3)?
Vim | 70 | vim license | \bvim license\b
Beerware | 80 | beer-ware | \bbeer-ware licen[cs]e\b
Beerware | 80 | beerware | \bbeerware licen[cs]e\b
JSON | 85 | shall be used for good, not evil | the software shall be used for good, not evil
Ms-EULA | 50 | end user license agreement | \bend user license agreement\b
LPPL-1.3c | 80 | latex project public license | latex project public license(?:,? ?(?:version )?1\.3[abc]?)?
LPPL-1.3c | 80 | lppl-1.3 | \blppl-1\.3[ac]?\b
Info-ZIP | 70 | info-zip license | \binfo-zip license\b
bzip2-1.0.6 | 80 | bzip2-1.0 | \bbzip2-1\.0\.[56]\b
TCL | 60 | tcl/tk license | \btcl/tk license\b
HPND | 80 | hpnd | \bhpnd(?:-sell-variant)?\b
HPND | 70 | historical permission notice | historical permission notice and disclaimer
Zend-2.0 | 80 | zend license | \bzend license\b
ZPL-2.1 | 80 | zope public license | zope public license(?:,? ?\(?zpl\)?)?(?:,? ?(?:version )?[12]\.[01])?
ZPL-2.1 | 80 | zpl-2.1 | \bzpl-2\.[01]\b
Xnet | 60 | x.net license | \bx\.net license\b
CeCILL-2.1 | 85 | cecill-2.1 | \bcecill-2\.1\b
CeCILL-B | 80 | cecill-b | \bcecill-b\b
CeCILL-C | 80 | cecill-c | \bcecill-c\b
CeCILL | 50 | cecill | \bcecill\b
MulanPSL-2.0 | 85 | mulan psl | \bmulan psl ?v?2\b
MulanPSL-2.0 | 85 | mulanpsl-2.0 | \bmulanpsl-2\.0\b
UPL-1.0 | 85 | universal permissive license | universal permissive license(?:,? ?(?:version |v)?1\.0)?
UPL-1.0 | 85 | upl-1.0 | \bupl-1\.0\b
BlueOak-1.0.0 | 85 | blue oak model license | blue oak model license(?: 1\.0\.0)?
BlueOak-1.0.0 | 85 | blueoak-1.0.0 | \bblueoak-1\.0\.0\b
Parity-7.0.0 | 80 | parity public license | parity public license
Hippocratic-2.1 | 80 | hippocratic license | hippocratic license
Anti-996 | 80 | anti-996 | \banti-996 licen[cs]e\b
OpenRAIL | 85 | openrail | \b(?:creativeml )?openrail(?:-m|\+\+-m)?\b
BigScience-RAIL-1.0 | 85 | bigscience | bigscience (?:open)?rail(?:-m)? license
Llama-2 | 80 | llama 2 community license | llama 2 community license
Llama-3 | 80 | llama 3 community license | llama 3(?:\.[1-3])? community license
Public-Domain | 60 | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
Public-Domain | 40 | in the public domain | \bin the public domain\b
Proprietary | 60 | all rights reserved | \ball rights reserved\b
Proprietary | 60 | proprietary and confidential | \bproprietary and confidential\b
Proprietary | 60 | unauthorized copying of this file | unauthorized copying of this file,? via any medium,? is strictly prohibited
SPDX-tag | 99 | spdx-license-identifier | spdx-license-identifier: ?[a-z0-9.+()-]+(?: (?:and|or|with) [a-z0-9.+()-]+)*
Copyright-notice | 20 | copyright | \bcopyright (?:\(c\) |© )?(?:19|20)\d\d\b
Warranty-disclaimer | 20 | without warranty of any kind | (?:provided )?"?as is"?,? without warranty of any kind
"""

RULES: list[tuple[str, int, str, str]] = [(a, int(b), c, d) for a, b, c, d in (line.split(" | ", 3) for line in _TEXT.strip().splitlines())]
