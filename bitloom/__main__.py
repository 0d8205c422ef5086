import sys

from bitloom.cli import main

sys.exit(main())
