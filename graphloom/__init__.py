"""graphloom: a PySpark engine that turns paper collections into knowledge graphs and analyses them."""
