"""soundgrid: catalogue-scale audio and keyed-series analytics on PySpark."""
