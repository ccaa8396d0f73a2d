import sys

from ledgerloom.cli import main

sys.exit(main())
