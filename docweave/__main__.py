import sys

from docweave.cli import main

sys.exit(main())
