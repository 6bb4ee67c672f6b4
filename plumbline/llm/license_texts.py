"""Wordings by which published licenses are known, one passage each; a label has as many as it needs.  Fixed values."""

PASSAGES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    (
        "apache",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("cc-by", "licensed under CC BY"),
    ("cc-by", "licensed under a Creative Commons Attribution"),
    ("cc-by-nc", "licensed under CC BY-NC"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial"),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND"),
    ("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nd", "licensed under CC BY-ND"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives"),
    ("cc-by-sa", "licensed under CC BY-SA"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions",
    ),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (
        "mit",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
