"""namtok: Thai and mixed-script text analytics as Spark DataFrame and Column operators."""
