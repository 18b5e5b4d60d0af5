import sys

from tidegraph.cli import main

sys.exit(main())
