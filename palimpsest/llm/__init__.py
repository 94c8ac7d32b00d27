"""Training-data operators. Nothing outside this subpackage imports it.

Conventions that hold for every operator here:

* a null text counts as an empty text; a null id is kept as null and sorts last;
* rows that agree in id and text are one document and get the same answer;
* columns that the caller adds are carried along untouched where an operator
  returns its input rows, whatever they are called; a result of the operator
  replaces a column of its name;
* an empty table gives an empty result with the same columns.
"""
