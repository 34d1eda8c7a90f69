"""Hand-written signatures over lower-cased words joined by one space. Fixed values of the license scan."""

_ANY = "(?: [^ ]+){0,12}"  # some words in between

#: Label and the regular expressions of a licence's own wording; ~ marks wording that many licences share.
TEXTS = (
    ("mit", (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    )),
    ("mit-0", ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction" + _ANY + " the software is provided as is",)),
    ("mit-x11", (
        "except as contained in this notice the name" + _ANY + " shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written (?:authorization|permission)",
        "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee",
    )),
    ("bsd", (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials",
        "this software is provided by the (?:copyright holders and contributors|author|regents and contributors) as is and any express or implied warranties",
        "in no event shall the (?:copyright (?:owner|holder|holders)|author|authors|regents)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages",
        "use of this source code is governed by a bsd style licen[sc]e",
    )),
    ("bsd-3-clause", (
        "neither the names? of" + _ANY + " may be used to endorse or promote products derived from this software without specific prior written permission",
        "the names? of" + _ANY + " may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission",
    )),
    ("bsd-4-clause", ("all advertising materials mentioning features or use of this software must display the following acknowledge?ment",)),
    ("bsd-3-clause-clear", ("no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e",)),
    ("0bsd", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is",)),
    ("isc", (
        "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice",
        "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "isc disclaims all warranties with regard to this software",
    )),
    ("ntp", ("permission to use copy modify and distribute this software and its documentation for any purpose(?: with or without fee)? is hereby granted provided that the above copyright notice appears in all copies",)),
    ("zlib", (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software" + _ANY + " conditions",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software" + _ANY + " (?:notice may not be removed or altered from any source )?redistribution",
    )),
    ("libpng", ("permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee subject to the following restrictions",)),
    ("apache-2.0", (
        "licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e",
        "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis without warranties or conditions of any kind",
        "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e",
        "you may obtain a copy of the licen[sc]e at (?:https? )?(?:www )?apache org licenses license 2 0",
        "subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) licen[sc]e",
        "licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements",
        "if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a readable copy of the attribution notices" + _ANY + " licen[sc]e",
    )),
    ("apache-1.1", (
        "this product includes software developed by the apache software foundation",
        "the names apache and apache software foundation must not be used to endorse or promote products derived from this software",
        "products derived from this software may not be called apache nor may apache appear in their name",
    )),
    ("gpl", (
        "this (?:program|library|software|file|package) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e",
        "you should have received a copy of the gnu general public licen[sc]e along with",
        "this program comes with absolutely no warranty for details type show w this is free software and you are welcome to redistribute it",
        "see the gnu general public licen[sc]e for more details",
        "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed",
        "the licen[sc]es for most software(?: and other practical works)? are designed to take away your freedom to share and change",
    )),
    ("gpl-2.0", (
        "under the terms of the gnu general public licen[sc]e as published by the free software foundation(?: either)? version 2(?! [0-9])(?: of the licen[sc]e)?(?: or at your option any later version)?",
        "the gnu general public licen[sc]e is intended to guarantee your freedom to share and change free software" + _ANY,
        "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously" + _ANY + " copyright",
        "this licen[sc]e applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public licen[sc]e",
    )),
    ("gpl-3.0", (
        "under the terms of the gnu general public licen[sc]e as published by the free software foundation(?: either)? version 3(?! [0-9])(?: of the licen[sc]e)?(?: or at your option any later version)?",
        "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works",
        "you may convey verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously" + _ANY + " copyright",
        "no covered work shall be deemed part of an effective technological measure under any applicable law fulfilling obligations under article 11 of the wipo copyright treaty",
    )),
    ("gpl-1.0", ("under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 1(?! [0-9])",)),
    ("lgpl", (
        "this (?:program|library|software|file|package) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e",
        "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with",
        "see the gnu (?:lesser|library) general public licen[sc]e for more details",
    )),
    ("lgpl-2.1", (
        "under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1(?: of the licen[sc]e)?(?: or at your option any later version)?",
        "this is the first released version of the lesser gpl it also counts as the successor of the gnu library public licen[sc]e version 2",
    )),
    ("lgpl-2.0", (
        "under the terms of the gnu library general public licen[sc]e as published by the free software foundation either version 2(?! 1)",
        "this is the first released version of the library gpl it is numbered 2 because it goes with version 2 of the ordinary gpl",
    )),
    ("lgpl-3.0", (
        "under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3(?: of the licen[sc]e)?(?: or at your option any later version)?",
        "this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e",
    )),
    ("agpl-3.0", (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e",
        "you should have received a copy of the gnu affero general public licen[sc]e along with",
        "the gnu affero general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
        "under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3(?: of the licen[sc]e)?(?: or at your option any later version)?",
        "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network" + _ANY + " licen[sc]e",
    )),
    ("gfdl", (
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e",
        "with no invariant sections no front cover texts and no back cover texts a copy of the licen[sc]e is included",
        "the purpose of this licen[sc]e is to make a manual textbook or other functional and useful document free",
    )),
    ("gcc-exception-3.1", ("under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception version 3 1",)),
    ("classpath-exception", ("linking this library statically or dynamically with other modules is making a combined work based on this library thus the terms and conditions of the gnu general public licen[sc]e cover the whole combination",)),
    ("autoconf-exception", ("as a special exception to the gnu general public licen[sc]e if you distribute this file as part of a program that contains a configuration script generated by autoconf",)),
    ("mpl-2.0", (
        "this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "covered software means source code form to which the initial contributor has attached the notice in exhibit a the executable form" + _ANY + " licen[sc]e",
        "this source code form is incompatible with secondary licen[sc]es as defined by the mozilla public licen[sc]e",
    )),
    ("mpl-1.1", (
        "the contents of this file are subject to the mozilla public licen[sc]e version 1 1",
        "alternatively the contents of this file may be used under the terms of either the gnu general public licen[sc]e version 2 or later the gpl or the gnu lesser general public licen[sc]e",
    )),
    ("mpl-1.0", ("the contents of this file are subject to the mozilla public licen[sc]e version 1 0",)),
    ("npl", ("the contents of this file are subject to the netscape public licen[sc]e",)),
    ("epl", (
        "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e",
        "the accompanying program is provided under the terms of this eclipse public licen[sc]e",
    )),
    ("epl-1.0", ("made available under the terms of the eclipse public licen[sc]e v(?:ersion)? ?1 0 which accompanies this distribution",)),
    ("epl-2.0", (
        "made available under the terms of the eclipse public licen[sc]e (?:v ?|version )?2 0 which is available at",
        "this source code may also be made available under the following secondary licen[sc]es when the conditions for such availability set forth in the eclipse public licen[sc]e",
    )),
    ("edl-1.0", ("made available under the terms of the eclipse distribution licen[sc]e v ?1 0",)),
    ("cpl-1.0", ("the accompanying program is provided under the terms of this common public licen[sc]e",)),
    ("ipl-1.0", ("the accompanying program is provided under the terms of this ibm public licen[sc]e",)),
    ("cddl", (
        "the contents of this file are subject to the terms of the common development and distribution licen[sc]e",
        "you can obtain a copy of the licen[sc]e at usr src opensolaris licen[sc]e",
        "when distributing covered code include this cddl header in each file" + _ANY + " licen[sc]e",
    )),
    ("eupl", (
        "licen[sc]ed under the eupl",
        "this european union public licen[sc]e the eupl applies to the work or software",
        "unless required by applicable law or agreed to in writing software distributed under the eupl licen[sc]e",
    )),
    ("cecill", (
        "this software is governed by the cecill(?: [abc])? licen[sc]e under french law and abiding by the rules of distribution of free software",
        "the fact that you are presently reading this means that you have had knowledge of the cecill(?: [abc])? licen[sc]e",
    )),
    ("osl-3.0", ("licen[sc]ed under the open software licen[sc]e version 3 0",)),
    ("afl-3.0", ("licen[sc]ed under the academic free licen[sc]e version 3 0",)),
    ("qpl-1.0", ("this file is part of" + _ANY + " and may be distributed under the terms of the q public licen[sc]e",)),
    ("artistic", (
        "the intent of this document is to state the conditions under which a package may be copied",
        "you may modify and distribute this package under the terms of the artistic licen[sc]e",
        "you can redistribute it and or modify it under the same terms as perl itself" + _ANY + " licen[sc]e",
    )),
    ("artistic-2.0", ("this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed",)),
    ("bsl-1.0", (
        "distributed under the boost software licen[sc]e version 1 0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e",
        "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor" + _ANY + " warrant(?:y|ies)",
    )),
    ("unlicense", (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    )),
    ("wtfpl", (
        "do what the fuck you want to public licen[sc]e",
        "everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed as long as the name is changed",
    )),
    ("beerware", ("as long as you retain this notice you can do whatever you want with this stuff" + _ANY + " (?:buy me a beer )?licen[sc]e", "the beer ?ware licen[sc]e")),
    ("cc0-1.0", (
        "to the extent possible under law" + _ANY + " has waived all copyright and related or neighbou?ring rights to this work",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
        "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights",
    )),
    ("cc-by-4.0", (
        "this work is licen[sc]ed under a creative commons attribution 4 0 international licen[sc]e",
        "by exercising the licen[sc]ed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public licen[sc]e",
    )),
    ("cc-by-3.0", ("this work is licen[sc]ed under a creative commons attribution 3 0 (?:unported|[a-z]+(?: states)?) licen[sc]e",)),
    ("cc-by-sa-4.0", (
        "this work is licen[sc]ed under a creative commons attribution share ?alike 4 0 international licen[sc]e",
        "text is available under the creative commons attribution share ?alike 4 0 licen[sc]e",
        "the terms and conditions of this creative commons attribution share ?alike 4 0 international public licen[sc]e",
    )),
    ("cc-by-sa-3.0", ("text is available under the creative commons attribution share ?alike(?: 3 0)? licen[sc]e additional terms may apply", "this work is licen[sc]ed under a creative commons attribution share ?alike 3 0 (?:unported|[a-z]+(?: states)?) licen[sc]e")),
    ("cc-by-nc-4.0", ("this work is licen[sc]ed under a creative commons attribution non ?commercial 4 0 international licen[sc]e", "the terms and conditions of this creative commons attribution non ?commercial 4 0 international public licen[sc]e")),
    ("cc-by-nc-sa-4.0", ("this work is licen[sc]ed under a creative commons attribution non ?commercial share ?alike 4 0 international licen[sc]e", "the terms and conditions of this creative commons attribution non ?commercial share ?alike 4 0 international public licen[sc]e")),
    ("cc-by-nc-nd-4.0", ("this work is licen[sc]ed under a creative commons attribution non ?commercial no ?derivatives 4 0 international licen[sc]e", "the terms and conditions of this creative commons attribution non ?commercial no ?derivatives 4 0 international public licen[sc]e")),
    ("cc-by-nd-4.0", ("this work is licen[sc]ed under a creative commons attribution no ?derivatives 4 0 international licen[sc]e",)),
    ("ofl-1.1", (
        "this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1",
        "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies",
        "neither the font software nor any of its individual components in original or modified versions may be sold by itself" + _ANY + " (?:bundled )?redistributed",
    )),
    ("odbl-1.0", ("this" + _ANY + " is made available under the open database licen[sc]e", "any rights in individual contents of the database are licen[sc]ed under the database contents licen[sc]e")),
    ("pddl-1.0", ("this" + _ANY + " is made available under the public domain dedication and licen[sc]e",)),
    ("odc-by-1.0", ("this" + _ANY + " is made available under the open data commons attribution licen[sc]e",)),
    ("ogl-uk-3.0", ("contains public sector information licen[sc]ed under the open government licen[sc]e v ?3 0", "you are encouraged to use and re use the information that is available under this licen[sc]e freely and flexibly with only a few conditions")),
    ("psf-2.0", (
        "this licen[sc]e agreement is between the python software foundation psf and the individual or organization licen[sc]ee accessing and otherwise using",
        "psf hereby grants licen[sc]ee a nonexclusive royalty free world wide licen[sc]e to reproduce analyze test perform and or display publicly",
    )),
    ("php-3.01", (
        "this source file is subject to version 3 0?1 of the php licen[sc]e",
        "products derived from this software may not be called php nor may php appear in their name without prior written permission",
    )),
    ("ruby", ("you can redistribute it and or modify it under either the terms of the 2 clause bsdl",)),
    ("openssl", (
        "this product includes software developed by the openssl project for use in the openssl toolkit",
        "redistributions of any form whatsoever must retain the following acknowledgment" + _ANY + " openssl",
        "this product includes cryptographic software written by eric young",
    )),
    ("ncsa", ("to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",)),
    ("upl-1.0", ("subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data",)),
    ("w3c", ("by obtaining using and or copying this work you the licen[sc]ee agree that you have read understood and will comply with the following terms and conditions",)),
    ("curl", ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",)),
    ("icu", ("permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation",)),
    ("unicode", ("unicode inc hereby grants the right to freely use the information supplied in this file", "permission is hereby granted free of charge to any person obtaining a copy of data files and any associated documentation")),
    ("hpnd", ("permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted",)),
    ("ms-pl", ("the terms reproduce reproduction derivative works and distribution have the same meaning here as under u s copyright law a contribution is the original software",)),
    ("busl-1.1", (
        "use of this software is governed by the business source licen[sc]e included in the licen[sc]e file",
        "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licen[sc]ed work",
        "effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licen[sc]ed work",
    )),
    ("sspl-1.0", ("if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available" + _ANY + " licen[sc]e",)),
    ("elastic-2.0", ("you may not provide the software to third parties as a hosted or managed service", "you may not move change disable or circumvent the licen[sc]e key functionality in the software")),
    ("commons-clause", ("the software is provided to you by the licensor under the licen[sc]e as defined below subject to the following condition", "without limiting other conditions in the licen[sc]e the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software")),
    ("polyform-noncommercial", ("the licensor grants you a copyright licen[sc]e for the software to do everything you might do with the software that would otherwise infringe the licensor s copyright in it for any permitted purpose",)),
    ("openrail", ("use based restrictions as referenced in paragraph 5 must be included as an enforceable provision by you in any type of legal agreement" + _ANY + " licen[sc]e", "the model is licen[sc]ed under the bigscience openrail m licen[sc]e")),
    ("cpal-1.0", ("the contents of this file are subject to the common public attribution licen[sc]e version 1 0",)),
    ("jpl-image", ("unless otherwise noted images and video on jpl public web sites may be used for any purpose without prior permission",)),
    ("json", ("the software shall be used for good not evil" + _ANY + " warrant(?:y|ies)",)),
    ("ijg", ("this software is based in part on the work of the independent jpeg group" + _ANY + " copyright",)),
    ("ftl", ("portions of this software are copyright" + _ANY + " the freetype project", "the freetype project is copyright")),
    ("vim", ("there are no restrictions on distributing unmodified copies of vim except that they must include this licen[sc]e text",)),
    ("sleepycat", ("redistributions in any form must be accompanied by information on how to obtain complete source code for the" + _ANY + " software",)),
    ("blueoak-1.0.0", ("each contributor licen[sc]es you to do everything with this software that would otherwise infringe that contributor s copyright in it",)),
    ("mulan-psl-2.0", ("you can use this software according to the terms and conditions of the mulan psl v ?2",)),
    ("ecl-2.0", ("licen[sc]ed under the educational community licen[sc]e version 2 0",)),
    ("lppl-1.3c", ("this work may be distributed and or modified under the conditions of the latex project public licen[sc]e",)),
    ("zpl", ("this software is subject to the provisions of the zope public licen[sc]e",)),
    ("aladdin", ("this file is distributed under the aladdin free public licen[sc]e",)),
    ("public-domain", (
        "(?:is |are )?(?:hereby )?(?:placed|released|put) (?:in|into) the public domain",
        "no copyright is claimed in the united states under title 17",
        "works? of the united states government and is in the public domain",
        "is not subject to copyright protection (?:within|in) the united states",
        "the copyright of this work has expired and it is now in the public domain",
        "no known copyright restrictions",
    )),
    ("proprietary", (
        "this (?:software|document|file|source code|material) (?:is|contains)(?: the)? (?:confidential and )?proprietary(?: and confidential)?",
        "unpublished proprietary source code of",
        "confidential and proprietary information of",
        "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: or distribution)? of this (?:file|program|material|document|software)" + _ANY + " is strictly prohibited proprietary and confidential",
        "may not be reproduced or (?:distributed|transmitted) in any form(?: or by any means)? without the prior written permission of",
        "no part of this (?:publication|book|document|work) may be reproduced" + _ANY + " without (?:the )?(?:prior |express )*(?:written )?permission",
        "this software is licen[sc]ed not sold",
        "licen[sc]ed materials property of ibm",
        "for evaluation purposes only" + _ANY + " licen[sc]e",
    )),
    ("~rights-reserved", ("copyright" + _ANY + " all rights reserved", "all rights reserved" + _ANY + " copyright", "this (?:article|page|site|website|blog|photo|image) is copyrighted")),
    ("~permissive-wording", ("permission is hereby granted", "permission to use copy modify(?: and)? distribute", "redistribution and use", "redistribution is permitted", "redistributions? of source code", "without warranty of any kind", "without any warranty")),
    ("~copyleft-wording", ("copyleft(?: [^ ]+){0,6} licen[sc]e", "under the same licen[sc]e(?: as the original)?", "derivative works must be licen[sc]ed under")),
    ("~non-commercial-wording", ("for (?:non ?)?commercial (?:use|purposes) only", "(?:not be used|may not be used) for commercial purposes without permission")),
)

#: Identifiers of the tag rules, by which the label is named.
SPDX = """
0BSD AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause
BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0
CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0
CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPAL-1.0 CPL-1.0 curl ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.1 GFDL-1.2
GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU IJG IPL-1.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 Libpng LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0
MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 NTP ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0
Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""

#: Addresses where licences are kept.
ADDRESSES = (
    ("apache-2.0", "apache org licenses license 2 0"),
    ("apache-1.1", "apache org licenses license 1 1"),
    ("mit", "opensource org licenses mit(?: license(?: php)?)?"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("bsd", "opensource org licenses bsd license(?: php)?"),
    ("isc", "opensource org licenses isc"),
    ("zlib", "opensource org licenses zlib"),
    ("gpl-2.0", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu org licenses gpl 3 0"),
    ("gpl", "gnu org licenses(?: gpl)?"),
    ("gpl", "gnu org copyleft gpl"),
    ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0"),
    ("lgpl", "gnu org licenses lgpl"),
    ("agpl-3.0", "gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", "gnu org (?:licenses|copyleft) fdl"),
    ("mpl-2.0", "mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org mpl mpl 1 1"),
    ("mpl", "mozilla org mpl"),
    ("epl-1.0", "eclipse org legal epl v10 licen[sc]e"),
    ("epl-2.0", "eclipse org legal epl 2 0 licen[sc]e"),
    ("bsl-1.0", "boost org licen[sc]e 1 0"),
    ("ofl-1.1", "scripts sil org ofl licen[sc]e"),
    ("unlicense", "unlicense org"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain mark 1 0"),
    *((f"cc-{kind.replace(' ', '-')}-{v.replace(' ', '.')}", f"creativecommons org licenses {kind} {v}") for kind in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd") for v in ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("odbl-1.0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "opendatacommons org licenses by"),
    ("pddl-1.0", "opendatacommons org licenses pddl"),
    ("ogl-uk-3.0", "nationalarchives gov uk doc open government licen[sc]e version 3"),
    ("python", "python org (?:psf|[0-9 ]+) licen[sc]e"),
    ("php-3.01", "php net licen[sc]e 3 01"),
    ("cecill", "cecill info licen[sc]es"),
    ("eupl-1.2", "joinup ec europa eu(?: [^ ]+){0,6} eupl(?: [^ ]+){0,4} licen[sc]e"),
)
