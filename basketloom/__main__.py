from basketloom.cli import main

main()
