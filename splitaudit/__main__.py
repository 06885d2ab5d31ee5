import sys

from splitaudit.cli import main

sys.exit(main())
