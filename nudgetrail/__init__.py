"""Did a message campaign change how items are priced? A PySpark library.

Every step is a plain DataFrame-to-DataFrame function; ``plans.study`` chains them.
"""
