"""Texts by which licences are known: whole short licences, openings of long ones, headers, and statements made by rule."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """A text of a licence.  ``must``: of each group of phrases one has to stand in a block that is taken for it (versions
    decide there).  ``whole``: a file that starts with it is the licence's own text."""

    license: str
    text: str
    must: tuple[tuple[str, ...], ...] = ()
    whole: bool = False


# The wording of public licences.
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. {_NO_WARRANTY}"""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_FSF_END = """This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with
this {what}. If not, see <https://www.gnu.org/licenses/>."""
_FSF_LATER = "This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. "
_FSF_ONLY = "This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} version {v} as published by the Free Software Foundation. "
OPENING_APACHE_2_0 = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1.
Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of
this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal
Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with
that entity. For the purposes of this definition, "control" means (i) the power, direct or indirect, to cause the direction or management
of such entity, whether by contract or otherwise, or (ii) ownership of fifty percent (50%) or more of the outstanding shares, or (iii)
beneficial ownership of such entity. "You" (or "Your") shall mean an individual or Legal Entity exercising permissions granted by this
License. "Source" form shall mean the preferred form for making modifications, including but not limited to software source code,
documentation source, and configuration files. "Object" form shall mean any form resulting from mechanical transformation or translation
of a Source form, including but not limited to compiled object code, generated documentation, and conversions to other media types. "Work"
shall mean the work of authorship, whether in Source or Object form, made available under the License, as indicated by a copyright notice
that is included"""
OPENING_GPL_2_0 = """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor,
Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not
allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU
General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all
its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors
commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.) You can
apply it to your programs, too. When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are
designed to make sure that you have the freedom to distribute copies of free software (and charge for this service if you wish), that you
receive source code or can get it if you want it, that you can change the software or use pieces of it in new free programs; and that you
know you can do these things. To protect your rights, we need to make restrictions that forbid anyone to deny you these rights or to ask
you to surrender the rights. These restrictions translate to certain responsibilities for you if you distribute copies of the software, or
if you"""
OPENING_GPL_3_0 = """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is
permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public
License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are
designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee
your freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software
Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its
authors. You can apply it to your programs, too. When we speak of free software, we are referring to freedom, not price. Our General
Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you
wish), that you receive source code or can get it if you want it, that you can change the software or use pieces of it in new free
programs, and that you know you can do these things. To protect your rights, we need to prevent others from denying you these rights or
asking you to surrender the rights. Therefore, you have certain responsibilities if you distribute copies of the software, or if you
modify it:"""
OPENING_LGPL_2_1 = """GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street,
Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing
it is not allowed. [This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public
License, version 2, hence the version number 2.1.] Preamble The licenses for most software are designed to take away your freedom to share
and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to
make sure the software is free for all its users. This license, the Lesser General Public License, applies to some specially designated
software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it. You can use it too, but we
suggest you first think carefully about whether this license or the ordinary General Public License is the better strategy to use in any
particular case, based on the explanations below. When we speak of free software, we are referring to freedom of use, not price. Our
General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for this
service if you wish); that you receive source code or can get it if you want it; that you can change the software and use pieces of it in
new free programs; and that you are"""
OPENING_LGPL_3_0 = """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is
permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser
General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the
additional permissions listed below. 0. Additional Definitions. As used herein, "this License" refers to version 3 of the GNU Lesser
General Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License. "The Library" refers to a covered work
governed by this License, other than an Application or a Combined Work as defined below. An "Application" is any work that makes use of an
interface provided by the Library, but which is not otherwise based on the Library. Defining a subclass of a class defined by the Library
is deemed a mode of using an interface provided by the Library. A "Combined Work" is a work produced by combining or linking an
Application with the Library. The particular version of the Library with which the Combined Work was made is also called the "Linked
Version". The "Minimal Corresponding Source" for a Combined Work means the Corresponding Source for the Combined Work, excluding any
source code for portions of the Combined Work that, considered in isolation, are based on the Application, and not"""
OPENING_MPL_2_0 = """Mozilla Public License Version 2.0 ================================== 1. Definitions -------------- 1.1. "Contributor" means each
individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the
combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution. 1.3.
"Contribution" means Covered Software of a particular Contributor. 1.4. "Covered Software" means Source Code Form to which the initial
Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code
Form, in each case including portions thereof. 1.5. "Incompatible With Secondary Licenses" means (a) that the initial Contributor has
attached the notice described in Exhibit B to the Covered Software; or (b) that the Covered Software was made available under the terms of
version 1.1 or earlier of the License, but not also under the terms of a Secondary License. 1.6. "Executable Form" means any form of the
work other than Source Code Form. 1.7. "Larger Work" means a work that combines Covered Software with other material, in a separate file
or files, that is not Covered Software. 1.8. "License" means this document. 1.9. "Licensable" means having the"""
OPENING_CC0_1_0 = """Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES.
DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN "AS-IS"
BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER, AND
DISCLAIMS LIABILITY FOR DAMAGES RESULTING FROM THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER. Statement of
Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below)
upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").
Certain owners wish to permanently relinquish those rights to a Work for the purpose of contributing to a commons of creative, cultural
and scientific works ("Commons") that the public can reliably and without fear of later claims of infringement build upon, modify,
incorporate in other works, reuse and redistribute as freely as possible in any form whatsoever and for any purposes, including without
limitation commercial purposes. These owners may contribute to the Commons to promote the ideal of a free"""
OPENING_ARTISTIC_1_0 = """The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the
Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package
the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications.
Definitions: "Package" refers to the collection of files distributed by the Copyright Holder, and derivatives of that collection of files
created through textual modification. "Standard Version" refers to such a Package if it has not been modified, or has been modified in
accordance with the wishes of the Copyright Holder as specified below. "Copyright Holder" is whoever is named in the copyright or
copyrights for the package. "You" is you, if you're thinking about copying or distributing this Package. "Reasonable copying fee" is
whatever you"""

# Names and versions from which statements, headers and tags are made.
FSF = (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
CC = (("CC-BY", "CC BY", "Attribution"), ("CC-BY-SA", "CC BY-SA", "Attribution-ShareAlike"), ("CC-BY-NC", "CC BY-NC", "Attribution-NonCommercial"), ("CC-BY-ND", "CC BY-ND", "Attribution-NoDerivatives"), ("CC-BY-NC-SA", "CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-NC-ND", "CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
OTHERS = (("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("Zlib", "zlib"))


def _major(version: str) -> str:
    return version if "." in version else f"{version}.0"


def _fsf():
    for short, name, versions in FSF:
        for v in versions:
            spdx = f"{short}-{_major(v)}"
            said = ((name,), (f"version {v}", f"v{v}", f"v {v}"))
            what = "library" if short == "LGPL" else "program"
            yield Template(f"{spdx}-or-later", (_FSF_LATER + _FSF_END).format(what=what, name=name, v=v), ((name,), (f"version {v}",), ("any later version",)))
            yield Template(f"{spdx}-only", (_FSF_ONLY + _FSF_END).format(what=what, name=name, v=v), said)
            for text in (f"This work is licensed under the {name}, version {v}.", f"Licensed under the {name} v{v}.", f"under the terms of the {name} version {v}"):
                yield Template(spdx, text, said)
            for tail in ("", "-only", "-or-later"):
                yield Template(spdx + tail, f"SPDX-License-Identifier: {spdx}{tail}", ((f"SPDX-License-Identifier: {spdx}{tail}",),))


def _tag(spdx: str) -> Template:
    return Template(spdx, f"SPDX-License-Identifier: {spdx}", ((f"SPDX-License-Identifier: {spdx}",),))


def templates() -> list[Template]:
    """All templates; of equal matches the first one's counts."""
    apache, mozilla = (("Apache License",), ("version 2.0", "v2.0", "v 2.0")), (("Mozilla Public License",), ("v. 2.0", "version 2.0", "v2.0"))
    out = [
        Template("MIT", MIT, whole=True),
        Template("BSD-3-Clause", f"{_BSD_TOP} {_BSD_NAMES} {_BSD_END}", (("may be used to endorse",),), whole=True),
        Template("BSD-2-Clause", f"{_BSD_TOP} {_BSD_END}", (("distribution this software is provided",),), whole=True),
        Template("ISC", ISC, whole=True),
        Template("Zlib", ZLIB, whole=True),
        Template("Unlicense", UNLICENSE, whole=True),
        Template("BSL-1.0", BOOST, whole=True),
        Template("Apache-2.0", OPENING_APACHE_2_0, (("Apache License version 2.0",),), whole=True),
        Template("GPL-2.0", OPENING_GPL_2_0, (("GNU General Public License version 2",),), whole=True),
        Template("GPL-3.0", OPENING_GPL_3_0, (("GNU General Public License version 3",),), whole=True),
        Template("AGPL-3.0", OPENING_GPL_3_0.replace("GENERAL PUBLIC LICENSE", "AFFERO GENERAL PUBLIC LICENSE").replace("General Public License", "Affero General Public License"), (("GNU Affero General Public License version 3",),), whole=True),
        Template("LGPL-2.1", OPENING_LGPL_2_1, (("GNU Lesser General Public License version 2.1",),), whole=True),
        Template("LGPL-3.0", OPENING_LGPL_3_0, (("GNU Lesser General Public License version 3",),), whole=True),
        Template("MPL-2.0", OPENING_MPL_2_0, (("Mozilla Public License version 2.0",),), whole=True),
        Template("CC0-1.0", OPENING_CC0_1_0, (("CC0 1.0",),), whole=True),
        Template("Artistic-1.0", OPENING_ARTISTIC_1_0, whole=True),
        Template("Apache-2.0", APACHE_HEADER, apache),
        Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", apache),
        Template("Apache-2.0", "Released under the Apache License v2.0", apache),
        Template("MPL-2.0", MPL_HEADER, mozilla),
        Template("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0.", mozilla),
        *_fsf(),
    ]
    for spdx, name in OTHERS:
        out += [Template(spdx, f"{said} under the {name} License.", ((f"{name} License",),)) for said in ("Released", "Licensed", "Distributed")]
        out.append(Template(spdx, f"This project is licensed under the terms of the {name} license.", ((f"{name} license",),)))
    for spdx, short, name in CC:
        out += [Template(f"{spdx}-4.0", f"Licensed under {short} 4.0.", ((f"{short} 4.0",),)), Template(f"{spdx}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.", ((f"Creative Commons {name} 4.0",),))]
    out += [Template("CC0-1.0", "Dedicated to the public domain under CC0 1.0.", (("CC0 1.0",),)), Template("LicenseRef-reserved", "All rights reserved.", (("All rights reserved",),))]
    out += [_tag(x) for x in ("Apache-2.0", "MPL-2.0", "Unlicense", "BSL-1.0", "CC0-1.0", "Artistic-1.0", *(s for s, _ in OTHERS), *(f"{s}-4.0" for s, *_ in CC))]
    return out
