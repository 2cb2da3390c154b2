"""Notices by which files name their licence, as publishers word them, and the phrases of each that must stand."""

from __future__ import annotations

#: (label, notice, mandatory phrases)
NOTICES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2 0",),
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted"),
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("may be used to endorse or promote products derived from this software",),
    ),
    (
        "bsd-4-clause",
        "All advertising materials mentioning features or use of this software must display the following acknowledgement",
        ("all advertising materials mentioning features or use of this software",),
    ),
    (
        "gpl-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("gnu general public license as published by the free software foundation either version 2",),
    ),
    (
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("gnu general public license as published by the free software foundation either version 3",),
    ),
    (
        "gpl-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        ("gnu general public license version 2 as published by",),
    ),
    (
        "lgpl-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("gnu lesser general public license as published by the free software foundation either version 2 1",),
    ),
    (
        "lgpl-3.0-or-later",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu lesser general public license as published by the free software foundation either version 3",),
    ),
    (
        "agpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu affero general public license as published by the free software foundation either version 3",),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("subject to the terms of the mozilla public license v 2 0",),
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        ("under the terms of the eclipse public license 2 0",),
    ),
    (
        "cddl",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",
        ("common development and distribution license",),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("in no event will the authors be held liable for any damages", "to alter it and redistribute it freely"),
    ),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)", ("boost software license version 1 0",)),
    (
        "wtfpl",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        ("copy and distribute verbatim or modified copies of this license document",),
    ),
    (
        "cc0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        ("dedicated all copyright and related and neighboring rights",),
    ),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.", ("creative commons attribution 4 0 international license",)),
    (
        "cc-by-sa-4.0",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
        ("creative commons attribution sharealike 4 0 international license",),
    ),
    (
        "cc-by-nc-4.0",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.",
        ("creative commons attribution noncommercial 4 0 international license",),
    ),
    (
        "cc-by-nd-4.0",
        "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nd/4.0/.",
        ("creative commons attribution noderivatives 4 0 international license",),
    ),
    (
        "postgresql",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
        ("without fee and without a written agreement is hereby granted",),
    ),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at https://scripts.sil.org/OFL", ("sil open font license version 1 1",)),
    ("artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License version 2.0", ("the terms of the artistic license version 2 0",)),
    ("eupl", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.", ("licensed under the eupl version 1",)),
    ("ms-pl", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.", ("this license governs use of the accompanying software",)),
    (
        "ncsa",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution.",
        ("this list of conditions and the following disclaimers redistributions in binary form",),
    ),
)
