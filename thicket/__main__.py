import sys

from thicket.cli import main

sys.exit(main())
