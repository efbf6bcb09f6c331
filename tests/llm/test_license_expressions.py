"""Licence notices that name several licences, exceptions or older forms."""

import pytest

from docloom.llm import licenses

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software developed by the organization.\n"
ENDORSE = "Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


@pytest.mark.parametrize(("text", "names"), [
    (BSD, ["BSD-2-Clause"]),
    (BSD + "3. " + ENDORSE.format("copyright holder"), ["BSD-3-Clause"]),
    (BSD + "3. " + ENDORSE.format("University"), ["BSD-3-Clause"]),
    (BSD + ADVERT + "4. " + ENDORSE.format("copyright holder"), ["BSD-4-Clause"]),
    (BSD + ADVERT + "4. " + ENDORSE.format("University"), ["BSD-4-Clause-UC"]),
    (BSD + ADVERT, ["BSD-4-Clause"]),
    ("This project is licensed under the MIT License - see the LICENSE file", ["MIT"]),
    ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", ["MIT"]),
    ("This project is licensed under the MIT Licence - see the [LICENSE.md](LICENSE.md) file for details.", ["MIT"]),
    ("This project is licensed under the Apache License, Version 2.0 - see the LICENSE file for details.", ["Apache-2.0"]),
    ("Dual licensed under the MIT license and the Apache License, Version 2.0", ["MIT", "Apache-2.0"]),
    ("Licensed under either of the Apache License, Version 2.0 or the MIT license.", ["Apache-2.0", "MIT"]),
    ("MIT licence", ["MIT"]),
    ("Released under the MIT Licence.", ["MIT"]),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]),
    ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
    ("spdx-license-identifier: ((GPL-2.0+ WITH GCC-exception-2.0) OR MIT) AND BSD-3-Clause", ["GPL-2.0+ WITH GCC-exception-2.0", "MIT", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: MIT.", ["MIT"]),
    ("SPDX-License-Identifier: MIT or so they say", ["MIT"]),
    ("The Artistic License 2.0", ["Artistic-2.0"]),
    ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0", ["CDDL-1.0"]),
    ("The contents of this file are subject to the terms of the Common Development and Distribution License (the License).", ["CDDL"]),
    ("She told the driver that all advertising materials are nice. A licence to drive.", []),
])
def test_names(text, names):
    assert licenses.scan(text)[0] == names
