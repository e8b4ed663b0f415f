"""Starting point for `spark-submit job.py <job> <input> <output>`."""

from laneflow.jobs import main

if __name__ == "__main__":
    main()
