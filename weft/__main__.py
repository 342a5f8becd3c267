import sys

from weft.cli import main

sys.exit(main(sys.argv[1:]))
