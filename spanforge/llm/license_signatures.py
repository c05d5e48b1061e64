"""Hand-written signatures of the license scan.

Each is a pattern of words (one space stands for whatever parts two words) with its label.
A signature's keyword is its longest run of words outside groups, so every match holds it.
"""

from __future__ import annotations

_WHO = "(?:program|library|file|package|software|work|code|font|plugin|module)"
_FSF = "as published by the free software foundation"
_GNU = _WHO + " is free software (?:and )?you can redistribute it and or modify it under the terms of the gnu"

#: Openings, headers and sentences that only one licence, or one family, has.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights"),
    ("x11", "except as contained in this notice the name(?: s)? of (?:the )?(?:above copyright holders|x consortium) shall not be used in advertising"),
    ("isc", "permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("bsd-0.clause", "for any purpose with or without fee is hereby granted the software is provided as is"),
    ("postgresql", "for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd-3.clause", "neither the name of (?:[0-9a-z]+ ){1,8}nor the names of (?:its |any |the )?contributors may be used to endorse or promote products"),
    ("bsd-3.clause", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4.clause", "all advertising materials mentioning features or use of this software must display the following"),
    ("bsd-2.clause", "the views and conclusions contained in the software and documentation are those of the authors"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse"),
    ("apache", "this product includes software developed (?:by|at) the apache software foundation"),
    ("gpl-3", _GNU + " general public license " + _FSF + " either version 3"),
    ("gpl-2", _GNU + " general public license " + _FSF + " either version 2"),
    ("gpl-2", _GNU + " general public license version 2 " + _FSF),
    ("gpl", _GNU + " general public license"),
    ("lgpl-3", _GNU + " lesser general public license " + _FSF + " either version 3"),
    ("lgpl-2.1", _GNU + " lesser general public license " + _FSF + " either version 2 1"),
    ("lgpl", _GNU + " (?:lesser|library) general public license"),
    ("agpl-3", _GNU + " affero general public license " + _FSF + " either version 3"),
    ("agpl", _GNU + " affero general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with"),
    ("gpl-1", "gnu general public license version 1 february 1989"),
    ("gpl-2", "gnu general public license version 2 june 1991"),
    ("gpl-3", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gnu-text", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("fdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("fdl", "with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-1.1", "alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("npl", "the contents of this file are subject to the netscape public license"),
    ("epl-2.0", "accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0"),
    ("epl-1.0", "accompanying materials are made available under the terms of the eclipse public license v(?:ersion)?(?: )?1 0"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("boost-1.0", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "the png reference library is supplied as is"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("cc0-1.0", "waived all copyright and related or neighbo(?:u)?ring rights"),
    ("cc0-1.0", "to the extent possible under law the (?:author|person|creator|publisher)"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "with reserved font name"),
    ("perl", "under the same terms as perl itself"),
    ("psf-2", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php-3.01", "this source file is subject to version 3 01 of the php license"),
    ("php-3.0", "this source file is subject to version 3 0 of the php license"),
    ("ruby", "under either the terms of the (?:gpl|bsdl)(?: version 2)? or the conditions below"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "this product includes cryptographic software written by eric young"),
    ("unicode", "any person obtaining a copy of the unicode data files and any associated documentation"),
    ("ijg", "this software is based in part on the work of the independent jpeg group"),
    ("ftl", "portions of this software are copyright (?:c )?(?:[0-9]+ )?the freetype project"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "the software shall be used for good not evil"),
    ("blessing", "may you do good and not evil"),
    ("busl-1.1", "make non production use of the licensed work"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("lppl", "may be distributed and or modified under the conditions of the latex project public license"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("osl-3.0", "licensed under the open software license version 3 0"),
    ("afl-3.0", "licensed under the academic free license version 3 0"),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon (?:as )?they will be approved"),
    ("upl-1.0", "licensed under the universal permissive license v 1 0 as shown at"),
    ("eula", "by (?:installing|downloading) copying or otherwise using (?:the|this) software you agree to be bound"),
    ("cc", "this work is licensed under (?:a|the) creative commons"),
    ("cc", "is made available under (?:a|the) creative commons licen[cs]e"),
)

#: Names of licences that the families do not hold.
NAMES = (
    ("apsl", "apple public source license"), ("cpal", "common public attribution license"), ("catosl", "computer associates trusted open source license"), ("cuaopl", "cua office public license"),
    ("ecl", "educational community license"), ("efl", "eiffel forum license"), ("entessa", "entessa public license"), ("eudatagrid", "eu datagrid software license"), ("erlpl", "erlang public license"),
    ("frameworx", "frameworx open license"), ("hpnd", "historical permission notice and disclaimer"), ("interbase", "interbase public license"), ("lucent", "lucent public license"), ("miros", "miros licen[cs]e"),
    ("motosoto", "motosoto open source license"), ("mulanpsl", "mulan permissive software license"), ("nasa", "nasa open source agreement"), ("naumen", "naumen public license"), ("ngpl", "nethack general public license"),
    ("nokia", "nokia open source license"), ("nposl", "non profit open software license"), ("ntp", "ntp license"), ("oclc", "oclc research public license"), ("openldap", "openldap public license"),
    ("qpl", "q public license"), ("rpsl", "realnetworks public source license"), ("rpl", "reciprocal public license"), ("rscpl", "ricoh source code public license"), ("simpl", "simple public license"),
    ("sleepycat", "sleepycat (?:public )?license"), ("sissl", "sun industry standards source license"), ("spl", "sun public license"), ("watcom", "sybase open watcom public license"), ("vsl", "vovida software license"),
    ("w3c", "w3c software (?:notice and license|and document notice and license)"), ("wxwindows", "wxwindows library licen[cs]e"), ("zpl", "zope public license"), ("cern-ohl", "cern open hardware licen[cs]e"),
    ("solderpad", "solderpad hardware licen[cs]e"), ("tapr-ohl", "tapr open hardware license"), ("blueoak", "blue oak model license"), ("npl", "netscape public license"), ("ypl", "yahoo public license"),
    ("zimbra", "zimbra public license"), ("sspl", "server side public license"), ("busl", "business source license"), ("elastic", "elastic license"), ("commons-clause", "commons clause license condition"),
    ("polyform", "polyform (?:noncommercial|small business|strict|shield|free trial|internal use|perimeter) license"), ("prosperity", "prosperity public license"), ("parity", "parity public license"),
    ("hippocratic", "hippocratic license"), ("anti-996", "anti 996 license"), ("openrail", "creativeml open(?: )?rail m"), ("openrail", "bigscience (?:bloom )?(?:open )?rail"), ("rail", "responsible ai licen[cs]e"),
    ("llama", "llama (?:[0-9](?: [0-9])? )?community license"), ("gemma", "gemma terms of use"), ("nvidia", "nvidia (?:software license agreement|source code license|open model license)"),
    ("intel", "intel simplified software license"), ("odc-by", "open data commons attribution license"), ("cdla", "community data license agreement"), ("dl-de", "datenlizenz deutschland"),
    ("etalab", "licence ouverte"), ("fbsd-doc", "freebsd documentation license"), ("opl", "open publication license"), ("opencontent", "open(?: )?content license"), ("fal", "free art license"), ("fal", "licence art libre"),
    ("dsl", "design science license"), ("lppl", "latex project public license"), ("gust", "gust font license"), ("vera", "bitstream vera fonts copyright"), ("ufl", "ubuntu font licen[cs]e"),
    ("arphic", "arphic public license"), ("ipa", "ipa font license"), ("cecill-b", "cecill b free software license"), ("cecill-c", "cecill c free software license"), ("tcl", "tcl tk license"),
    ("vim", "vim license"), ("ruby", "ruby license"), ("curl", "curl license"), ("icu", "icu license"), ("ftl", "freetype (?:project )?license"), ("postgresql", "postgresql licen[cs]e"),
    ("bsd", "bsd style licen[cs]e"), ("mit", "mit style licen[cs]e"), ("bsd-2.clause-patent", "bsd (?:plus|2 clause plus|with) patent"), ("mit-0", "mit no attribution"), ("mit", "expat license"),
    ("cc-by-nd", "creative commons attribution no(?: )?deriv(?:ative)?s"), ("cc-by-nc-nd", "creative commons attribution non(?: )?commercial no(?: )?deriv(?:ative)?s"), ("cc-pdm", "public domain mark 1 0"),
    ("cc-sampling", "creative commons sampling plus"), ("gfdl-code", "gnu simpler free documentation license"), ("gpl", "gnu public license"), ("gpl", "general public licence"), ("eula", "end user licen[cs]e agreement"),
)

#: Addresses of licence texts.
LINKS = (
    ("apache-2.0", "apache org licenses license 2 0"), ("apache-1.1", "apache org licenses license 1 1"), ("mit", "opensource org licen[cs]es? mit"), ("mit", "choosealicense com licenses mit"),
    ("bsd-2.clause", "opensource org licenses bsd 2 clause"), ("bsd-3.clause", "opensource org licenses bsd 3 clause"), ("isc", "opensource org licenses isc"), ("gpl-2", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "gnu org licenses gpl 3 0"), ("gpl", "gnu org (?:licenses|copyleft) gpl"), ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1"), ("lgpl-3", "gnu org licenses lgpl 3 0"), ("lgpl", "gnu org licenses lgpl"),
    ("agpl-3", "gnu org licenses agpl 3 0"), ("agpl", "gnu org licenses agpl"), ("fdl", "gnu org licenses fdl"), ("gnu", "gnu org licenses"), ("mpl-2.0", "mozilla org mpl 2 0"), ("mpl-1.1", "mozilla org mpl mpl 1 1"),
    ("mpl", "mozilla org mpl"), ("epl-2.0", "eclipse org legal epl (?:2 0|v20)"), ("epl-1.0", "eclipse org legal epl v10"), ("boost-1.0", "boost org license 1 0"), ("unlicense", "unlicense org"), ("wtfpl", "wtfpl net"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"), ("cc-pdm", "creativecommons org publicdomain mark 1 0"), ("cc-by", "creativecommons org licenses by"), ("cc-by-sa", "creativecommons org licenses by sa"),
    ("cc-by-nd", "creativecommons org licenses by nd"), ("cc-by-nc", "creativecommons org licenses by nc"), ("cc-by-nc-sa", "creativecommons org licenses by nc sa"), ("cc-by-nc-nd", "creativecommons org licenses by nc nd"),
    ("ofl", "scripts sil org ofl"), ("odbl", "opendatacommons org licenses odbl"), ("odc-by", "opendatacommons org licenses by"), ("pddl", "opendatacommons org licenses pddl"), ("polyform", "polyformproject org licenses"),
    ("upl-1.0", "oss oracle com licenses upl"), ("eupl", "joinup ec europa eu (?:software|collection eupl)"), ("spdx", "spdx org licenses"), ("osi", "opensource org licenses"),
)

#: Exceptions to a copyleft licence.
EXCEPTIONS = (
    ("exception:classpath", "classpath exception"), ("exception:classpath", "linking this library statically or dynamically with other modules is making a combined work"), ("exception:gcc", "gcc runtime library exception"),
    ("exception:autoconf", "autoconf (?:configure script )?exception"), ("exception:bison", "bison exception"), ("exception:bison", "you may create a larger work that contains part or all of the bison parser skeleton"),
    ("exception:font", "(?:gpl )?font exception"), ("exception:linking", "linking exception"), ("exception:openssl", "openssl (?:linking )?exception"), ("exception:linux", "linux syscall note"),
    ("exception:llvm", "llvm exceptions?"), ("exception:qt", "qt (?:company )?gpl exception"), ("exception:swift", "swift runtime library exception"), ("exception:foss", "(?:universal )?foss exception"),
    ("exception:wxwindows", "wxwindows (?:library )?exception"), ("exception", "as a special exception (?:to the|the copyright holders|you may)"),
)

#: Statements of rights that name no licence.
STATEMENTS = (
    ("reserved", "all rights reserved"), ("bsd", "redistribution and use in source and binary forms"),
    ("some-rights", "some rights reserved"), ("public-domain", "no rights reserved"), ("public-domain", "(?:dedicated to|in|into|part of) the public domain"), ("public-domain", "public domain work"), ("public-domain", "no copyright is claimed"),
    ("proprietary", "proprietary and (?:proprietary|confidential)"), ("proprietary", "confidential and (?:proprietary|confidential)"), ("proprietary", "trade secrets? of"), ("proprietary", "for internal use only"),
    ("proprietary", "not for redistribution"), ("proprietary", "licensed materials? property of"), ("proprietary", "unpublished (?:work|rights) reserved under the copyright laws"), ("proprietary", "this (?:software|material) is the property of"),
    ("reserved", "may not be (?:reproduced|copied|republished|redistributed)"), ("reserved", "without (?:the )?(?:prior |express )?(?:prior |express )?written (?:permission|consent) of"), ("reserved", "unauthori[sz]ed (?:reproduction|copying|distribution|use) (?:is|of this)"),
    ("reserved", "moral rights? of the author"), ("permission", "(?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission of"), ("non-commercial", "for non(?: )?commercial (?:use|purposes) only"),
    ("non-commercial", "for personal use only"), ("non-commercial", "for (?:personal|private) (?:and|or) non(?: )?commercial use"), ("research-only", "for (?:academic|research|educational) (?:use|purposes) only"),
    ("royalty-free", "royalty free (?:license|licence|use)"), ("no-derivatives", "no derivative works? (?:is|are) permitted"), ("share-alike", "share alike licen[cs]e"), ("crown", "crown copyright"), ("us-government", "work of the (?:us|united states) government"),
    ("restricted-rights", "use duplication or disclosure (?:by the government )?is subject to restrictions"),
)

#: Notices of a copyright.
NOTICES = (("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"), ("copyright", "copyright of the authors?"))
