from strandweave.plans.runner import main

main()
