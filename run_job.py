"""What spark-submit starts: ``spark-submit --py-files laneflow.zip run_job.py <job> <flags>``."""

from laneflow.plans.jobs import main

if __name__ == "__main__":
    main()
