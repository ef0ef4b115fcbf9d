"""A relation-tuple engine on Spark: stratified Datalog over attributed facts, and analyses of what follows from them."""
