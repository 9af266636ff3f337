"""``python -m fathom``."""

import sys

from fathom.cli import main

sys.exit(main())
