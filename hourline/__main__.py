from hourline.stages import main

main()
