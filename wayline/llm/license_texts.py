"""Licence texts and file headers, and digests of the long ones (licence, words, SHA-256 of their canonical words)."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{2}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {3} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
{0}://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {0}://mozilla.org/MPL/2.0/."""
_GNU = """{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version.
{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details.
You should have received a copy of the GNU {2}General Public License along with {4}. If not, see {5}://www.gnu.org/licenses/."""


def _texts():
    yield "MIT", _MIT
    for title in ("MIT License", "The MIT License", "The MIT License (MIT)"):
        yield "MIT", f"{title}\n{_MIT}"
    yield "ISC", _ISC
    for title in ("ISC License", "The ISC License"):
        yield "ISC", f"{title}\n{_ISC}"
    for spdx, marks, third in (("BSD-2-Clause", ("", "", ""), ""), ("BSD-2-Clause", ("1. ", "2. ", ""), ""), ("BSD-3-Clause", ("", "", ""), _THIRD), ("BSD-3-Clause", ("1. ", "2. ", "3. "), _THIRD)):
        for who in ("HOLDER", "OWNER"):
            text = _BSD.format(marks[0], marks[1], marks[2] + third if third else "", who)
            yield spdx, text
            for title in (f"BSD {spdx[4]}-Clause License", f"The BSD {spdx[4]}-Clause License"):
                yield spdx, f"{title}\n{text}"
    for http in ("http", "https"):
        yield "Apache-2.0", _APACHE.format(http)
        yield "MPL-2.0", _MPL.format(http)
        for name, kind, versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))):
            for version in versions:
                for what, end in (("This program", "this program"), ("This library", "this library"), ("This file", "this program")):
                    yield f"{name}-{version if '.' in version else version + '.0'}-or-later", _GNU.format(what, ":", kind, version, end, http)


TEXTS = list(dict.fromkeys(_texts()))
# Whole texts as Debian ships them, with and without the part that tells how to apply them.
DIGESTS = [
    ("Apache-2.0", 1590, "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847"),
    ("Apache-2.0", 1419, "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87"),
    ("Apache-2.0", 1414, "6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166"),
    ("Artistic-1.0", 983, "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("BSD-3-Clause", 217, "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", 1088, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 3315, "8446e2329e3fe2b35501056164a645d74fef33dc1b8a2a132629bf1935fa72e7"),
    ("GFDL-1.3", 3732, "961b6d8afa12e353079f8676ad28084c800a46123e76f7f4f7e7f81df82289dc"),
    ("GPL-1.0", 2067, "a39d7cceab675e14bdc24e269448ac0ed44fdef25178b183064cd4b35b8d2e7b"),
    ("GPL-1.0", 1641, "91b305cf86edf86f06cf0d2e2fd9a19411380eed7bcaf9a3cfd5df4653d4fa22"),
    ("GPL-1.0", 1636, "623616c29d1b130de555ac918949fb7b05b67711999871d9d8f68d4639e91089"),
    ("GPL-2.0", 2975, "cf74dfa78ca9ac981c7ae9e50c4ecfb828df2e5ef2f1646368388676215766b5"),
    ("GPL-2.0", 2504, "c33d2f29477d94c3f3e48ae230c47966a4f4c05a0f6087cf607e1589848d2986"),
    ("GPL-2.0", 2499, "255577de4e1e5d93258ddab6c40c41231b97e109d43f4b552501c6d77285763b"),
    ("GPL-3.0", 5684, "68ca42869e9a3e25843be66c6f296ce2b1f3629ac71d77465db0636dc8781c06"),
    ("GPL-3.0", 5241, "df20d6920a2688bef2bb6fb95fc7472aa40799a7027c0ce468190c67658a9656"),
    ("GPL-3.0", 5236, "71ebfd10fca4514433d163174bf2f5e27e4829ad059834ac56dae1098f4ebe49"),
    ("LGPL-2.0", 4200, "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e"),
    ("LGPL-2.0", 3865, "e29dcc167f8a363847b3c4b0a7ced67d7a2bb7b9112a3311b6877a9c0570d635"),
    ("LGPL-2.0", 3860, "b927da98cda221c8fbc56dfd2b6b2e80f6df686482d12dbac6b79da1ce6bb98a"),
    ("LGPL-2.1", 4401, "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-2.1", 4065, "2858f5a00f6672bd47f63b69b9bf4e1bc31f3541b08a5a263e59d9b384f72fdc"),
    ("LGPL-2.1", 4060, "2a9689b90bf823adea3df9024818d21d6041c74f3f12ab46ac5ac4d86f654b2e"),
    ("LGPL-3.0", 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 3760, "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", 2414, "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]
#: The first canonical words of those texts.
OPENINGS = {"Apache-2.0": "apache license version", "Artistic-1.0": "the artistic license", "BSD-3-Clause": "all rights reserved", "CC0-1.0": "creative commons legal",
            "GFDL-1.2": "gnu free documentation", "GFDL-1.3": "gnu free documentation", "GPL-1.0": "gnu general public", "GPL-2.0": "gnu general public", "GPL-3.0": "gnu general public",
            "LGPL-2.0": "gnu library general", "LGPL-2.1": "gnu lesser general", "LGPL-3.0": "gnu lesser general", "MPL-1.1": "mozilla public license", "MPL-2.0": "mozilla public license"}
